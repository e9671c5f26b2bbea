"""Hot keys, clashing names, long texts, empty tables, repeated rows and null ids."""

import hashlib
import os
import random
import subprocess
import sys
import time
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from brightweir import session
from brightweir.llm import decontaminate, language_id, mixing, near_copies, quality, registry, secrets, simhash, suffix_dedup, token_store, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SMALL = "/root/testdata/sf0.001"
NAMES = ("h", "name", "marks", "pos", "toxicity", "score", "lang_pred", "n_words", "n_hit", "contaminated", "hit_spans", "spans", "size", "target", "fp", "root", "node", "key", "nll", "lowest", "shard", "base_sha256", "id", "bucket")


def table(spark, texts, **more):
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in NAMES})


def operators(spark, tmp_path):
    import public_tokenizers

    items = spark.createDataFrame([(1, "ten words of a benchmark item that should never be seen")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    return {
        "op1": lambda d: suffix_dedup.dedup_substrings(d, passage_words=51),
        "op2": mixing.mix_table,
        "op2 mix": mixing.mix,
        "op3": quality.quality,
        "op4": secrets.find_secrets,
        "op5": language_id.identify,
        "op6": lambda d: decontaminate.contamination(d, items),
        "op8": simhash.near_duplicates,
        "op8 one": simhash.representatives,
        "near": near_copies.representatives,
        "op9": lambda d: token_store.tokenize(d, public_tokenizers.path("word_bpe_49k.json")),
        "op10": lambda d: toxicity.toxicity(d, labels),
    }


@pytest.mark.parametrize("name", ["op1", "op2", "op2 mix", "op3", "op4", "op5", "op6", "op8", "op8 one", "near", "op9", "op10"])
def test_clashing_names_long_texts_repeats_and_empty_tables(spark, tmp_path, name):
    run = operators(spark, tmp_path)[name]
    r = random.Random(0)
    long_ = " ".join(f"w{r.randrange(10**6)}" for _ in range(260_000))  # over 1 << 20 bytes
    texts = [long_, long_[5:] + " tail", None, "", " \n", "one two three " * 30, "x" * 70_000]
    docs = table(spark, texts)
    docs = docs.unionByName(docs.where("doc_id = 5"))
    out = run(docs)
    rows = out.count()
    assert rows == 8 if name not in ("op8 one", "near", "op2 mix") else 0 < rows <= 24
    assert "doc_id" in out.columns and len(set(out.columns)) == len(out.columns)
    assert run(docs.limit(0)).count() == 0


def test_long_texts_of_substrings_by_hand(spark):
    r = np.random.default_rng(1)
    noise = lambda n: bytes(r.integers(97, 123, n, dtype=np.uint8)).decode()
    passage = noise(900)
    a = noise(1_200_000) + passage + noise(300_000)
    b = noise(10) + passage
    got = {x.doc_id: x for x in suffix_dedup.dedup_substrings(table(spark, [a, b, "c" * 399, "d" * 400])).collect()}
    assert [(got[i].n_removed, got[i].n_spans) for i in range(4)] == [(900, 1), (900, 1), (0, 0), (0, 0)]
    assert got[0].spans[0]["start"] == 1_200_000 and got[1].kept_sha256 == hashlib.sha256(b[:10].encode()).hexdigest()


def test_a_bucket_of_two_thousand_alike_is_quick():
    base, r = random.Random(5).getrandbits(64), random.Random(6)
    prints = np.array(sorted({base ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(6000)}), np.uint64)
    began = time.perf_counter()
    links = simhash.bucket_links(prints, None, 4)
    took = time.perf_counter() - began
    assert len(prints) > 1500 and len(links) == len(prints) - 1 and took < 3
    assert len({x for pair in links for x in pair}) == len(prints)


def test_an_automaton_of_four_megabytes_is_bounded():
    code = """
import random, resource, sys
sys.path.insert(0, sys.argv[1])
from brightweir.llm import decontaminate
r = random.Random(0)
words = [f"{r.randrange(10**6):x}word" for _ in range(60_000)]
items = [(i, " ".join(r.choices(words, k=400)).encode()) for i in range(1100)]
size = sum(len(t) for _, t in items)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
decontaminate.Machine(items, 10)
print(size, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
"""
    out = subprocess.run([sys.executable, "-c", code, session.ROOT], capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 3_500_000 and int(out[1]) < 700_000, out


def test_items_in_pieces_lose_no_window():
    text = b" ".join(b"w%d" % i for i in range(100))
    parts = list(decontaminate._pieces(text, 10, 40))
    windows = lambda t: {tuple(w[i : i + 10]) for w in [t.split()] for i in range(len(w) - 9)}
    assert len(parts) > 5 and set().union(*map(windows, parts)) == windows(text)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    if name == "op7_warc":  # with equal payloads, of which the table has none
        con.execute(f"CREATE OR REPLACE VIEW pages AS SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN 'é' WHEN page_id % 7 = 0 THEN NULL ELSE html END AS html FROM '{SMALL}/pages.parquet'")
        pages = session.table(spark, SMALL, "pages").withColumn("html", F.when(F.col("page_id") % 3 == 0, "é").when(F.col("page_id") % 7 == 0, F.lit(None)).otherwise(F.col("html")))
        path = session.scratch(spark, "warc")
        warc.write_warc(pages, path)
        got = warc.read_warc(spark, path)
    else:
        got = registry.QUERIES[name](spark, SMALL)
    r = con.execute(registry.ORACLE_SQL[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == sorted(got.columns)
    key = lambda rows: sorted(tuple(map(str, x)) for x in rows)
    assert key(got.select(*names).collect()) == key(r.fetchall())


def test_archives_with_a_hot_payload_and_repeated_pages(spark, tmp_path):
    rows = [(i, None, "hot" if i % 3 == 0 else f"page {i}") for i in range(600)] + [(None, None, "hot"), (599, None, "page 599")]
    where = f"file://{tmp_path}/hot"
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), where, shard_bytes=20_000, roll_bytes=3_000)
    got = warc.read_warc(spark, where).collect()
    hot = [x for x in got if x.payload_bytes == 3]
    assert len(got) == 602 and sum(x.record_type == "response" for x in hot) == 1 and {x.refers_to for x in hot if x.record_type == "revisit"} == {597}
    again = [x for x in got if x.page_id == 599]
    assert sorted(x.record_type for x in again) == ["response", "revisit"]
    shards_ = {n.split("-")[1] for n in os.listdir(tmp_path / "hot") if n.endswith(".gz")}
    assert len([n for n in os.listdir(tmp_path / "hot") if n.endswith(".gz")]) > len(shards_)


def test_null_and_smallest_ids_are_told_apart(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path, low = public_tokenizers.path("word_bpe_49k.json"), -(1 << 63)
    rows = [(None, "a b"), (low, "c"), (None, "a"), (7, "same"), (7, "same"), (7, "other")]
    where = f"file://{tmp_path}/ids"
    token_store.write_store(spark.createDataFrame(rows, "doc_id long, text string"), where, path, 2)
    own = Tokenizer.from_file(path)
    crc = lambda t: zlib.crc32(np.array([*own.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes())
    got = sorted((x.start, x.key, x.ids_crc32) for x in token_store.read_documents(spark, where).collect())
    assert [(k, c) for _, k, c in got] == [(None, crc("a")), (None, crc("a b")), (low, crc("c")), (7, crc("other")), (7, crc("same")), (7, crc("same"))]
    asked = spark.createDataFrame([(low,), (None,), (8,)], "doc_id long")
    assert [x.doc_id for x in token_store.fetch(asked, where, "doc_id").collect()] == [low]


def test_a_third_of_all_rows_alike(spark):
    texts = ["the very same words in every one of these"] * 300 + [f"some other words number {i} are here now" for i in range(600)]
    docs = table(spark, texts)
    got = simhash.near_duplicates(docs).where("doc_id < 300").select("component_id").distinct().collect()
    assert [x[0] for x in got] == [0]
    assert near_copies.representatives(docs).where("doc_id < 300").count() == 1
    mixed = mixing.mix_table(docs.withColumn("source", F.when(F.col("doc_id") < 300, "hot").otherwise("cold")))
    per = mixed.groupBy("source_size").agg(F.sum("taken").alias("n"), F.first("target").alias("t")).collect()
    assert all(abs(x.n - x.t) <= 10 for x in per)


def test_repeated_rows_with_different_texts_are_dealt_evenly(spark):
    rows = [(1, "a b c", "en", "hot", 5)] * 40 + [(1, "d e f", "en", "hot", 5)] * 20 + [(2, "g h", "de", "cold", 3)] * 2 + [(3, "x y z", "en", None, 5)]
    docs = spark.createDataFrame(rows, DOCS)
    taken = mixing.mix(docs)
    assert taken.columns == docs.columns
    got = {tuple(x)[:2]: x["count"] for x in taken.groupBy("doc_id", "text").count().collect()}
    want = mixing.mix_table(docs).groupBy("doc_id").agg(F.sum("copies").alias("n")).collect()
    for x in want:
        assert sum(n for (i, _), n in got.items() if i == x.doc_id) == x.n
    per_copy = [got.get((1, "a b c"), 0) / 40, got.get((1, "d e f"), 0) / 20]
    assert abs(per_copy[0] - per_copy[1]) <= 1


def test_a_cluster_must_name_its_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://x:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_dir(Session())
