"""Corpus operators against brute force, with nulls, empty and repeated rows, ties, empty tables and clashing columns."""

import base64
import hashlib
import itertools
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from brightweir import session
from brightweir.llm import decontaminate, language_id, mixing, quality, secrets, shards, simhash, suffix_dedup, token_store, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SMALL = "/root/testdata/sf0.001"


def docs_of(spark, texts, lang="en", source="s"):
    return spark.createDataFrame([(i, t, lang, source, len(t or "")) for i, t in enumerate(texts)], DOCS)


def rng_texts(seed, n, words, longest=40):
    r = random.Random(seed)
    return [" ".join(r.choice(words) for _ in range(r.randint(0, longest))) for _ in range(n)]


# 1 -------------------------------------------------------------------------------------------------------------------
def brute_removed(texts, k):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + k] for r in raw for i in range(len(r) - k + 1))
    out = []
    for r in raw:
        hit = [False] * len(r)
        for i in range(len(r) - k + 1):
            if seen[r[i : i + k]] > 1:
                hit[i : i + k] = [True] * k
        spans = sum(h and not (i and hit[i - 1]) for i, h in enumerate(hit))
        kept = bytes(b for b, h in zip(r, hit, strict=True) if not h)
        out.append((len(r), sum(hit), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("k", [5, 24, 40])
def test_substrings(spark, k):
    texts = [*rng_texts(k, 40, ["ab", "ba", "é", "aaa", "xyz", "the long passage that returns"]), None, "", "short", "a" * 300]
    texts += [texts[3], texts[3], texts[5] + " tail"]
    df = docs_of(spark, texts).withColumnRenamed("source", "h")  # a name that the operator uses too
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup_substrings(df, min_len=k).collect()}
    assert [got[i] for i in range(len(texts))] == brute_removed(texts, k)


@pytest.mark.parametrize("k", [3, 8, 30])
def test_passages_of_words(spark, k):
    r = random.Random(k)
    known = [f"w{i}" for i in range(40)]
    shared = [[r.choice(known) for _ in range(n)] for n in (k - 1, k, k + 7)]
    own = [[f"u{j}x{i}" for i in range(r.randint(0, 60))] for j in range(40)]
    texts = [" ".join([*o, *r.choice(shared), *(r.choice(shared) if r.random() < 0.3 else []), *o[:5]]) for o in own]
    texts += [None, "", texts[7], " ".join(shared[2] * 3), "only  " + "\t".join(shared[1]), " ".join([f"v{i}" for i in range(k)] * 2)]
    split = [(t or "").split() for t in texts]
    holders = {}
    for i, w in enumerate(split):
        for a in range(len(w) - k + 1):
            holders.setdefault(tuple(w[a : a + k]), set()).add(i)
    want = [any(len(holders[tuple(w[a : a + k])]) > 1 for a in range(len(w) - k + 1)) for w in split]
    got = {x.doc_id: x.n_passage_words for x in suffix_dedup.dedup_substrings(docs_of(spark, texts), passage_words=k).collect()}
    assert [got[i] > 0 for i in range(len(texts))] == want and sum(want) > 5
    assert all(got[i] <= len(w) for i, w in enumerate(split))


def test_minima_and_an_empty_table(spark):
    x = np.array([5, 3, 3, 9, 1, 7, 1], np.uint64)
    assert suffix_dedup.minima(x, 3).tolist() == [2, 2, 4, 4, 6]
    assert suffix_dedup.dedup_substrings(docs_of(spark, ["x"]).limit(0), passage_words=51).count() == 0


def test_difference_cover():
    v, d = suffix_dedup.difference_cover(400)
    assert v > 100 and {(a - b) % v for a in d for b in d} == set(range(v))


# 2 -------------------------------------------------------------------------------------------------------------------
def brute_targets(sizes, most=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: i % 3 + 1 for i, s in enumerate(order)}
    left, free, out = sum(sizes.values()), set(order), {}
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > most * sizes[s]}
        for s in over or free:
            out[s] = most * sizes[s] if over else level * w[s]
            left -= out[s] if over else 0
        if not over:
            break
        free -= over
    return out


def test_mixing(spark):
    r = random.Random(2)
    rows = [(i, "w " * r.choice([1, 5, 40, 300]), r.choice(["a", "b", "b", "b", "b", "c", "", None, "é"])) for i in range(900)]
    rows += [(1000, "tiny one", "z"), (1001, None, "a"), (1002, "", "nowords"), (1003, "x\x0by\x1fz q", "a")] + [(2007, "same row", "c")] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_table(df).collect()
    assert len(got) == len(rows)
    key = lambda x: [tuple(y) for y in sorted(x, key=str)]
    assert key(got) == key(mixing.mix_table(df.repartition(7)).collect())
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    per, own = Counter(), {}
    for i, t, s in rows:
        per[s] += words(t)
        own[i] = (s, words(t))
    want, taken = brute_targets(dict(per)), Counter()
    for g in got:
        s, n = own[g.doc_id]
        assert (g.size, g.source_size) == (n, per[s]) and 0 <= g.taken <= 3 * n and g.taken == g.copies * n
        assert g.target == pytest.approx(want[s])
        taken[s] += g.taken
    for s, t in want.items():
        # One rounding is left; a source of a few documents may have none that is small.
        sizes = sorted(n for x, n in own.values() if x == s and n)
        assert abs(taken[s] - t) <= (sizes[len(sizes) // 2] if sizes else 0), (s, taken[s], t)
    assert mixing.mix_table(df.limit(0)).count() == 0
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    assert Counter(x.doc_id for x in mixed.collect() if x.doc_id != 2007) == Counter({g.doc_id: g.copies for g in got if g.copies and g.doc_id != 2007})


@pytest.mark.parametrize("sf, share", [("sf0.001", 0.03), ("sf0.01", 0.005)])
def test_mix_of_small_sources_is_near_its_targets(spark, sf, share):
    docs = session.table(spark, SMALL.replace("sf0.001", sf), "documents")
    per = mixing.mix_table(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("x"), F.expr("percentile(size, 0.5)").alias("median"))
    for r in per.collect():
        assert abs(r.x - r.t) <= r["median"] and abs(r.x - r.t) <= share * r.t, r


# 3 -------------------------------------------------------------------------------------------------------------------
def brute_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    three = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if three[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


@pytest.mark.parametrize("seed", range(6))
def test_quality_counts(seed):
    r = random.Random(seed)
    text = "".join(r.choice(["a ", "b ", "é# ", "\n", "a b c ", "\x0b", "\x1f", "c|d\n", "漢 "]) for _ in range(seed * 30))
    assert quality.counts(text.encode()) == brute_counts(text)


def test_quality_bands_reject_the_odd_one(spark):
    texts = [*(" ".join(random.Random(i).choices("the cat sat on a mat and ran to its dog by night".split(), k=80)) for i in range(60)), " ".join(f"zq{i}xk" for i in range(80)), None, "", "few words", "a b c " * 60]
    got = {r.doc_id: r for r in quality.quality(docs_of(spark, texts)).collect()}
    assert all(got[i].kept for i in range(60)) and not got[60].base_failed and not got[60].kept
    assert all(got[i].base_failed and not got[i].kept for i in range(61, 65))
    assert quality.quality(docs_of(spark, texts).limit(0)).count() == 0


# 4 -------------------------------------------------------------------------------------------------------------------
def test_secret_patterns_and_entropy(spark):
    s = secrets.Scanner()
    text = "x password = 'abcdefghijkl12' TOKEN:short AKIA1234567890ABCD 0123456789abcdef0123 secret: token: abcdefghijkl é api_key=zzzzzzzzzzzz"
    base = secrets._joined(sorted(s.base(text)))
    assert [x.split(":")[0] for x in base.split(",")] == ["assign", "access", "hex", "assign"]
    assert text[2:].startswith("password") and base.startswith("assign:2:")
    assert s.entropy("see Xk9fQ2mZ7pLw4Rt8Vb3Ns6Yd here") == [(4, 28)]
    for clean in ("123e4567-e89b-12d3-a456-426614174000", "internationalizationstrategies", "path/to/some/longer/file9/name", "ABCDEFGHIJKLMNOP0123456789", "a1" * 20):
        assert s.entropy(clean) == [], clean
    docs = docs_of(spark, [text, None, "", text, "K = 1"])
    got = {r.doc_id: r for r in secrets.find_secrets(docs).collect()}
    assert got[0].base_sha256 == hashlib.sha256(base.encode()).hexdigest() == got[3].base_sha256
    assert got[1].spans == got[2].spans == "" and got[1].base_sha256 == hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("seed", range(5))
def test_entropy_windows_match_direct_counts(seed):
    r = random.Random(seed)
    text = "".join(r.choice("abcdef0123456789XYZ"[: r.randint(2, 19)]) for _ in range(80))
    hit = [False] * 80
    for i in range(61):
        c = Counter(text[i : i + 20]).values()
        if -sum(x / 20 * math.log2(x / 20) for x in c) >= 3.2 - 1e-9:
            hit[i : i + 20] = [True] * 20
    got = [False] * 80
    for a, b in secrets.windows_of_entropy(text, 20, 3.2):
        got[a:b] = [True] * (b - a)
    assert got == hit


# 5 -------------------------------------------------------------------------------------------------------------------
@pytest.mark.skipif(not os.path.isdir(SMALL), reason="the driver's tables are not here")
def test_language_accuracy_on_held_out_rows(spark):
    docs = session.table(spark, SMALL.replace("0.001", "0.01"), "documents")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97 and all(0 <= r.score <= 1 for r in got)


def test_language_without_letters_and_without_training(spark):
    docs = docs_of(spark, ["hello world", None, "", "123 !?", "Hello", "xyzq"])
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[0][0] == got[5][0] == "en"
    none = language_id.identify(docs.withColumn("lang", docs.source.substr(9, 1)).where("false").unionByName(spark.createDataFrame([(1, "a", None, None, 1)], DOCS)))
    assert [tuple(r)[2:] for r in none.collect()] == [("und", 0.0)]


# 6 -------------------------------------------------------------------------------------------------------------------
def brute_leaks(texts, items, n=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    pats = [(i, tuple(w[k : k + n])) for i, t in items if (w := cut(t)) for k in range(max(1, len(w) - n + 1))]
    out = []
    for t in texts:
        w, hit, own = cut(t), set(), set()
        for i, p in pats:
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit |= set(range(k, k + len(p)))
                    own.add(i)
        out.append((len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(map(str, own))).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("max_bytes", [1 << 20, 40, 6])
def test_decontamination(spark, max_bytes):
    words = ["Who", "is", "the", "Élan", "9", "x-y", "of", "a"]
    items = [*enumerate(rng_texts(1, 12, words, 14)), (50, None), (51, ""), (52, "who IS"), (53, "..."), (52, "who IS")]
    texts = [*rng_texts(2, 30, words), None, "", "WHO is!", items[0][1] + " who " + items[3][1], items[4][1]]
    got = decontaminate.contamination(docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string"), max_bytes=max_bytes, window=4)
    found = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()}
    assert [found[i] for i in range(len(texts))] == brute_leaks(texts, items, 4)
    none = decontaminate.contamination(docs_of(spark, texts), spark.createDataFrame([], "item_id long, text string"))
    assert none.where("contaminated").count() == 0


def test_groups_in_turn_in_one_worker():
    class Held:
        def __init__(self, value):
            self.value = value

    for i in range(200):  # lists that are freed and built anew at the same address
        machine = decontaminate._machine(f"group {i}", Held([(i, b"one w%d two" % i)]), 3)
        assert machine.scan(b"so one w%d two" % i)[2] == {i}


def test_fifty_groups_are_as_one(spark):
    words = [f"w{i}" for i in range(40)]
    items = spark.createDataFrame(list(enumerate(rng_texts(5, 60, words, 30))), "item_id long, text string")
    docs = docs_of(spark, [*rng_texts(6, 200, words, 60), None, ""])
    docs = docs.unionByName(docs.where("doc_id < 5"))
    key = lambda df: sorted(map(str, df.collect()))
    one = decontaminate.contamination(docs, items, window=3)
    assert one.where("contaminated").count() > 5
    assert key(decontaminate.contamination(docs, items, window=3, max_bytes=100)) == key(one)


# 7 -------------------------------------------------------------------------------------------------------------------
def test_archives(spark, tmp_path):
    html = ["<p>a</p>", "b" * 5000, None, "", "<p>a</p>", "é", "b" * 5000, "<p>a</p>"]
    pages = spark.createDataFrame([(i * 3, None if i == 1 else f"http://x/{i}", h, "extra") for i, h in enumerate(html)], "page_id long, url string, html string, payload string")
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    last = {digest(h): i * 3 for i, h in enumerate(html)}
    want = {i * 3: (len((h or "").encode()), digest(h), "response" if last[digest(h)] == i * 3 else "revisit", None if last[digest(h)] == i * 3 else last[digest(h)]) for i, h in enumerate(html)}
    for name in ("one", "two"):
        warc.write_warc(pages, f"file://{tmp_path}/{name}", shard_bytes=3000, roll_bytes=400)
        got = warc.read_warc(spark, f"file://{tmp_path}/{name}", with_payload=True).collect()
        assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == want
        assert all(bytes(r.payload).decode() == (html[r.page_id // 3] or "") for r in got if r.record_type == "response")
    files = lambda n: {p.name: p.read_bytes() for p in (tmp_path / n).glob("*.warc.gz")}
    assert files("one") == files("two") and len(files("one")) > 1
    warc.write_warc(pages.limit(0), f"file://{tmp_path}/none")
    assert warc.read_warc(spark, f"file://{tmp_path}/none").count() == 0


# 8 -------------------------------------------------------------------------------------------------------------------
def brute_print(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark):
    base = rng_texts(5, 25, [f"w{i}" for i in range(400)], 120)
    r = random.Random(1)
    near = [re.sub(r"w\d+", lambda m: m[0] if r.random() > 0.01 else "new", t, count=0) for t in base for _ in range(3)]
    texts = [*base, *near, None, "", "  ", "One two", "one TWO", base[0].upper()]
    prints = [brute_print(t) for t in texts]
    up = list(range(len(texts)))
    root = lambda x: x if up[x] == x else root(up[x])
    for a, b in itertools.combinations(range(len(texts)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 4:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    df = docs_of(spark, texts)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert got == {i: (f"{prints[i]:016x}", root(i)) for i in range(len(texts))}
    assert sorted(x.doc_id for x in simhash.representatives(df).collect()) == sorted({root(i) for i in range(len(texts))})


@pytest.mark.parametrize("tile", [8, 1000])
def test_near_links_in_tiles(spark, tile):
    r = random.Random(3)
    some = [r.getrandbits(64) for _ in range(40)]
    prints = sorted({*some, *(x ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for x in some * 3)})
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    links = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), 4, tile=tile).collect()
    assert len(links) >= 1
    mask = (1 << 64) - 1
    assert all(((a & mask) ^ (b & mask)).bit_count() <= 4 for a, b in links)
    up = {x: x for x in prints}
    root = lambda x: x if up[x] == x else root(up[x])
    for a, b in links:
        up[root(a & mask)] = root(b & mask)
    for a, b in itertools.combinations(prints, 2):
        assert (a ^ b).bit_count() > 4 or root(a) == root(b)


# 9 -------------------------------------------------------------------------------------------------------------------
def test_token_store(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    words = ["It's", "a", "Été,", "x.y", "<|endoftext|>", "12", "naïve!?", "漢字", "\t", "don't", "Ünïcode"]
    texts = [*rng_texts(9, 60, words), None, "", " ", "a" * 3000]
    own = Tokenizer.from_file(path)
    ids = [[*own.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    df = docs_of(spark, texts)
    where = f"file://{tmp_path}/store"
    token_store.write_store(df.repartition(5), where, path, 2, shard_bytes=4000)
    start, want = 0, {}
    for i, x in enumerate(ids):
        want[i] = (start, len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
        start += len(x)
    assert {r.key: (r.start, r.n_tokens, r.ids_crc32) for r in token_store.read_documents(spark, where).collect()} == want
    asked = spark.createDataFrame([(3,), (59,), (63,), (999,), (None,)], "doc_id long")
    assert {r.doc_id: r.ids for r in token_store.fetch(asked, where, "doc_id").collect()} == {i: ids[i] for i in (3, 59, 63)}
    token_store.write_store(df.limit(0), f"file://{tmp_path}/none", path, 2)
    assert token_store.read_documents(spark, f"file://{tmp_path}/none").count() == 0


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(0).integers(-(1 << 62), 1 << 62, 5000))
    slots = token_store.PerfectHash.build(keys).slots(keys)
    assert sorted(slots.tolist()) == list(range(len(keys)))


def test_range_edges_ignore_partitions(spark):
    rows = [(i * i, 10 + i % 7) for i in range(500)]
    df = spark.createDataFrame(rows, "key long, size long")
    edges = shards.range_edges(df, 400)
    assert edges == shards.range_edges(df.repartition(9), 400) and len(edges) > 5


# 10 ------------------------------------------------------------------------------------------------------------------
def test_toxicity_finds_planted_words(spark):
    r = random.Random(4)
    plain = ["".join(r.choice("aeioulnrst") for _ in range(r.randint(3, 8))) for _ in range(3000)]
    bad = ["vilescum", "hateful", "wretchlike", "dumbfool"]
    rows = []
    for i in range(700):
        y = int(i % 3 == 0)
        w = [r.choice(plain) for _ in range(r.randint(40, 90))]
        for k in range(0, len(w), 12):
            if y:
                w[k] = r.choice(bad)
        rows.append((i, " ".join(w), y))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9001, None), (9002, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(9001, None)], "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.toxicity(docs, labels).collect()}
    held = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert len(held) > 80 and np.mean([p == y for p, y in held]) > 0.9
    assert got[9001].score == got[9002].score and all(0 <= x.score <= 1 for x in got.values())
    assert all(x.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, x in got.items())
    none = toxicity.toxicity(docs, labels.limit(0)).collect()
    assert {x.score for x in none} == {0.0}
