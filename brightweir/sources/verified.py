"""Reference files that are read only if they are what their manifest says: bytes, rows, unique keys and one scheme.

A manifest has a row a file (path, sha256 of the unpacked bytes, bytes, rows, scheme). Files are unpacked and hashed where they
are read, a file in a task; what they hold is trusted once hash, size, number of rows and keys are right, all files are there
and none is there that the manifest doesn't name. Everything is checked in the plan, and what is wrong comes back as rows.

Files are CSV with a header, packed or not; a file is held whole by the task that hashes it, so reference data comes in files of
bounded size. Empty manifests trust nothing.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """(path, sha256, bytes) of the files of a folder, of their unpacked bytes; null where a packed file is broken."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                raw = bytes(content)
                try:
                    plain = gzip.decompress(raw) if path.endswith(".gz") else raw
                except (OSError, EOFError):
                    rows.append((path, None, None))
                    continue
                rows.append((path, hashlib.sha256(plain).hexdigest(), len(plain)))
            yield pd.DataFrame(rows, columns=["path", "sha256", "bytes"]).astype({"bytes": "Int64"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv*").load(folder).select("path", "content")
    return files.mapInPandas(run, "path string, sha256 string, bytes long").withColumn("path", name(F.col("path"), folder))


def name(path: Column, folder: str) -> Column:
    """Where a file is in its folder, as manifests have it."""
    return F.regexp_extract(path, rf"/\Q{folder.rstrip('/').rsplit('/', 1)[-1]}\E/(.*)$", 1)


def scanned(spark: SparkSession, folder: str, manifest: DataFrame, schema: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows of files without a fault, with path; faults: path, fault). A key that two files have is a fault of both; where
    schemes differ, none of the files is trusted."""
    have = digests(spark, folder)
    read = spark.read.schema(schema).option("header", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv*").csv(folder).withColumn("path", name(F.col("_metadata.file_path"), folder))
    counts = read.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.count(key).alias("keys"))
    twice = read.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.collect_set("path").alias("paths")).where("n > 1").select(F.explode("paths").alias("path")).distinct().withColumn("twice", F.lit(True))
    schemes = manifest.agg(F.count_distinct("scheme").alias("schemes"))  # one row
    told = manifest.select("path", F.col("sha256").alias("t_sha"), F.col("bytes").alias("t_bytes"), F.col("rows").alias("t_rows"), "scheme", F.lit(True).alias("told"))
    all_ = told.join(have.withColumn("there", F.lit(True)), "path", "full").join(counts, "path", "left").join(twice, "path", "left").join(F.broadcast(schemes))
    n = F.coalesce("n", F.lit(0))
    faults = F.array_compact(
        F.array(
            F.when(F.col("told").isNull(), "not_in_manifest"),
            F.when(F.col("there").isNull(), "missing"),
            F.when(F.col("told") & F.col("there") & F.col("sha256").isNull(), "broken"),
            F.when(F.col("told") & (F.col("sha256") != F.col("t_sha")), "hash_differs"),
            F.when(F.col("told") & (F.col("bytes") != F.col("t_bytes")), "size_differs"),
            F.when(F.col("told") & F.col("there") & (n != F.col("t_rows")), "count_differs"),
            F.when(F.coalesce(F.col("twice"), F.lit(False)), "key_repeated"),
            F.when(n > F.coalesce("keys", F.lit(0)), "key_missing"),
            F.when(F.col("told") & ((F.col("schemes") > 1) | F.col("scheme").isNull()), "scheme_differs"),
        )
    )
    state = all_.select("path", faults.alias("faults"))
    trusted = read.join(state.where("size(faults) = 0").select("path"), "path", "left_semi")
    return trusted, state.select("path", F.explode("faults").alias("fault"))
