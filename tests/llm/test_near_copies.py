"""Near copies against brute force."""

import itertools
import random

import numpy as np

from brightweir.llm import near_copies

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(r, n):
    return [f"w{r.randrange(5000)}" for _ in range(n)]


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b)


def edited(r, base, share):
    return [w if r.random() > share else "new" for w in base]


def test_pipeline_drops_near_copies_of_five_words(spark):
    import corpus_pipeline

    r = random.Random(4)
    bases = [words(r, r.choice([6, 40, 150, 400])) for _ in range(30)]
    texts = [" ".join(x) for b in bases for x in (b, *(edited(r, b, s) for s in (0.005, 0.015, 0.02, 0.03)))] + [None, "", " ", "One two", "one  TWO"]
    sets = [shingles(t) for t in texts]
    up = list(range(len(texts)))
    root = lambda x: x if up[x] == x else root(up[x])
    for a, b in itertools.combinations(range(len(texts)), 2):
        if similar(sets[a], sets[b]):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(x.doc_id for x in kept.collect()) == sorted({root(i) for i in range(len(texts))})
    assert near_copies.representatives(docs.limit(0)).count() == 0


def test_similarity_is_checked_in_whole_numbers():
    a = np.arange(8, dtype=np.uint64)
    assert near_copies.alike(a, np.arange(10, dtype=np.uint64)) and not near_copies.alike(a, np.arange(11, dtype=np.uint64))


def test_a_large_group_with_links_of_every_strength(spark):
    r = random.Random(11)
    base = words(r, 60)
    texts = [" ".join(edited(r, base, 0.03)) for _ in range(150)]
    sets = [shingles(t) for t in texts]
    up = list(range(len(texts)))
    root = lambda x: x if up[x] == x else root(up[x])
    for a, b in itertools.combinations(range(len(texts)), 2):
        if similar(sets[a], sets[b]):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    kept = near_copies.representatives(docs)
    assert sorted(x.doc_id for x in kept.collect()) == sorted({root(i) for i in range(len(texts))})


def test_parities_rule_out_no_similar_pair(spark):
    r = np.random.default_rng(2)
    base = r.integers(0, 1 << 63, 400, np.uint64)
    pairs = []
    for _ in range(300):
        n, d = r.integers(1, 300), r.integers(0, 80)
        a = np.unique(base[:n])
        b = np.unique(np.r_[base[d % n : n], r.integers(0, 1 << 63, d, np.uint64)])
        pairs.append((len(a), len(b), near_copies.alike(a, b), *near_copies.parity(a).tolist(), *near_copies.parity(b).tolist()))
    cols = ["m", "n", "alike", *(f"p{k}" for k in range(8)), *(f"q{k}" for k in range(8))]
    df = spark.createDataFrame([tuple(int(x) if not isinstance(x, bool) else x for x in p) for p in pairs], cols)
    got = df.select("alike", near_copies.few_enough("m", "n").alias("may")).collect()
    assert all(x.may for x in got if x.alike) and sum(x.alike for x in got) > 20 and sum(not x.may for x in got) > 100


def test_fingerprints_alone_find_near_copies(spark, monkeypatch):
    """With a bucket of its own for each set, MinHash finds nothing: what is dropped was linked by op8's operator."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    r, found = random.Random(6), near_copies.with_buckets
    bases = [words(r, 300) for _ in range(40)]
    texts = [" ".join(x) for b in bases for x in (b, [*b[:-1], "new"])]
    monkeypatch.setattr(near_copies, "with_buckets", lambda *a: found(*a).withColumn("buckets", F.array(F.xxhash64("node"))))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    kept = {x.doc_id for x in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "").collect()}
    assert kept == set(range(0, len(texts), 2))


def test_fingerprint_pairs_connect_all_within_the_radius(spark):
    r = random.Random(9)
    base = [r.getrandbits(64) for _ in range(20)]
    prints = [b ^ sum(1 << k for k in r.sample(range(64), r.randrange(12))) for b in base for _ in range(8)]
    prints += prints[:30]
    nodes = spark.createDataFrame([(i.to_bytes(4), p - (1 << 64) if p >> 63 else p, 10) for i, p in enumerate(prints)], "node binary, fp long, n int")
    got = {(int.from_bytes(x.a), int.from_bytes(x.b)) for x in near_copies.fingerprint_pairs(nodes).collect()}
    near = {(a, b) for a, b in itertools.combinations(range(len(prints)), 2) if (prints[a] ^ prints[b]).bit_count() <= near_copies.RADIUS}

    def parts(links):
        up = list(range(len(prints)))
        root = lambda x: x if up[x] == x else root(up[x])
        for a, b in links:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
        return [root(i) for i in range(len(prints))]

    assert got <= near and len(got) < len(near) and parts(got) == parts(near)


def test_near_copies_lets_go_of_shuffles_between_its_steps(spark, monkeypatch):
    swept, calls = near_copies.swept, []
    monkeypatch.setattr(near_copies, "swept", lambda df: (calls.append(1), swept(df))[1])
    docs = spark.createDataFrame([(i, "a b c d e f g", "en", "s", 13) for i in range(3)], DOCS)
    assert [x.doc_id for x in near_copies.representatives(docs).collect()] == [0] and len(calls) == 6
