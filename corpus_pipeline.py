"""Preparation of a training corpus: five stages, each an operator of brightweir.llm over all that the stage before kept.

Every stage but the last returns the columns of documents. Nulls, empty texts, repeated rows and empty tables are
treated as the operators say: a text without words is kept by the filters, and of those all but one go as duplicates.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightweir import session
from brightweir.llm import decontaminate, mixing, near_copies, token_store, toxicity


def _wrapped(docs: DataFrame) -> DataFrame:
    """Text and whole row, so that an operator's columns meet none of the table's."""
    return docs.select(F.struct(*docs.columns).alias("row"), "text")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below a half."""
    model = toxicity.fit(docs, session.table(spark, sf_dir, "labels"))
    return toxicity.scored(_wrapped(docs), model).where("toxicity < 0.5").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the document with the smallest id: SimHash
    fingerprints linked by op8's operator, then MinHash buckets for what they leave apart, all checked with the sets."""
    return near_copies.representatives(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = decontaminate.contamination(_wrapped(docs), session.table(spark, sf_dir, "benchmark"))
    return found.where("NOT contaminated").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in binary shards, read back: doc_id, start, n_tokens, ids_crc32."""
    return token_store.tokenize(docs, public_tokenizers.path("word_bpe_49k.json"))


def _prepared(stage):
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        session.ship(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("toxicity", _prepared(drop_toxic)),
    ("near_duplicates", _prepared(drop_near_copies)),
    ("decontamination", _prepared(drop_benchmark)),
    ("mixing", _prepared(mix_sources)),
    ("tokens", _prepared(write_tokens)),
]

#: Neither compression lengths nor fingerprints nor tokens can be computed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = session.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = session.scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            session.discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
