"""Filter audit, byte-pair merging and collocations against brute force, with edge cases."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from brightweir.llm import bpe, collocations, filter_audit

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("part", "w", "t", "A", "E", "good", "toxic", "subset", "kept", "first", "digest", "f", "n", "key", "phrase", "total", "ids", "decoded", "n_tokens")
PATH = public_tokenizers.path("word_bpe_49k.json")


def table(spark, rows):
    docs = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], DOCS)
    return docs.withColumns({c: F.lit("clash") for c in CLASH})


# 11 ------------------------------------------------------------------------------------------------------------------
def brute_report(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    lowest = {}
    for i, t, _, _ in rows:
        if i is not None:
            lowest[t or ""] = min(i, lowest.get(t or "", i))
    docs = []
    for i, t, _, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 2 * len(t))
        fails += "D" * bool(re.search(r"[#$%&*|]", t)) + "E" * (i is not None and i > lowest[t])
        docs.append((s or "", fails, i in good, i in toxic))
    out, shares = {}, Counter()
    for part in {d[0] for d in docs}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [d for d in docs if d[0] == part]
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                mine = [d for d in docs if d[0] == part and f in d[1]]
                out[part, order, step] = [f, len(left), len(gone), len(mine) - len(gone), sum(d[1] == f for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone)]
                shares[part, f] += len(gone)
    return {k: (*v, shares[k[0], v[0]]) for k, v in out.items()}


def audit_rows():
    r = random.Random(3)
    words = ["alpha", "Beta", "GAMMA", "de$ta", "e|", "é", "x"]
    rows = []
    for i in range(400):
        n = r.choice([0, 5, 150, 199, 200, 260])
        pool = words[: r.randint(1, 7)] if r.random() < 0.5 else [f"w{k}" for k in range(400)]
        text = r.choice([" ", "\n", "\t "]).join(r.choice(pool) for _ in range(n))
        rows.append((i, text, "en", r.choice(["hot", "hot", "hot", "b", "", None])))
    rows += [(900 + i, rows[i % 7][1], "en", "hot") for i in range(120)]  # a group of copies
    rows += [(None, None, None, None), (None, "", "en", "b"), (5, rows[5][1], "en", "b"), (7, "again", "en", "c"), (7, "again", "en", "c")]
    return rows


def test_audit_of_filters(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "CHUNK", 64)
    rows = audit_rows()
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 1000, 3)] + [(3, 1, 1), (3, 0, 0), (6, None, None), (None, 1, 1)]
    got = filter_audit.interactions(table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    found = {(r.part, r.filter_order, r.step): (r.filter, r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got}
    assert len(got) == len(found) == 4 * 600
    assert found == brute_report(rows, labels)


def test_audit_of_nothing_and_of_very_many_parts(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.interactions(table(spark, []), labels).count() == 0
    rows = [(i, "a word", "en", f"s{i}") for i in range(300)]
    flat = filter_audit.interactions(table(spark, rows), labels).where("filter_order = 'ABCDE' AND step = 1")
    assert flat.count() == 300 and flat.where("removed = 1 AND kept = 0").count() == 300


# 12 ------------------------------------------------------------------------------------------------------------------
def odd_texts():
    r = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyzABCXYZ 0123456789 .,;:!?'\"-_#$%&*()[]{}<>|/\\\t\n\réÀßñœ日本語한국어ελλΣς́  😀‍\x00\x1c\x85İ"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(1, 300))) for _ in range(250)]
    texts += ["It's WE'LL they're I'm don't", "<|endoftext|>", "a<|startoftext|>b<|endoftext|><|endoftext|>", "<|ENDOFTEXT|> <|end", "'s't're", " ", "\n\n", "é é", "ΑΣ ΑΣΑ", "x" * 5000, "aab" * 3000, "1234567890" * 50]
    texts += [" ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(1, 14))) for _ in range(400)) for _ in range(20)]
    return texts


def test_merging_and_decoding_against_the_library(spark):
    library = Tokenizer.from_file(PATH)
    texts = [*odd_texts(), None, ""]
    docs = table(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    docs = docs.unionByName(docs.where("doc_id = 3"))
    got = bpe.encode(docs, PATH, columns=("n_tokens", "ids", "ids_sha256", "decoded", "decoded_sha256"))
    rows = got.collect()
    assert len(rows) == len(texts) + 1 and len(set(got.columns)) == len(got.columns)
    for r in rows:
        want = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        text = library.decode(want, skip_special_tokens=False)
        assert r.ids == want and r.n_tokens == len(want) and r.decoded == text, texts[r.doc_id]
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    back = bpe.decode(got.select("doc_id", F.col("decoded").alias("d"), F.when(F.col("doc_id") != 1, F.col("ids")).alias("ids")), PATH)
    assert back.where("doc_id != 1 AND NOT decoded <=> d").count() == 0 and back.where("doc_id = 1 AND decoded IS NULL").count() == 1
    assert bpe.encode(docs.limit(0), PATH).count() == 0


def naive_merges(word, ranks):
    """The lowest rank first, leftmost first, looked for anew each time."""
    sym = list(word)
    while True:
        best = min(((ranks[p], i) for i, p in enumerate(itertools.pairwise(sym)) if p in ranks), default=None)
        if best is None:
            return sym
        sym[best[1] : best[1] + 2] = ["".join(sym[best[1] : best[1] + 2])]


@pytest.mark.parametrize("seed", range(6))
def test_queue_against_naive_merging(seed):
    r = random.Random(seed)
    vocab, merges = list("abc"), []
    while len(merges) < 40:
        a, b = r.choice(vocab), r.choice(vocab)
        if (a, b) not in merges and len(a + b) < 9:
            merges.append((a, b))
            if a + b not in vocab:
                vocab.append(a + b)
    m = bpe.Merges({"vocab": {t: i for i, t in enumerate(vocab)}, "merges": merges, "end_of_word_suffix": ""})
    ranks = {p: i for i, p in enumerate(merges)}
    for _ in range(300):
        word = "".join(r.choice("aabc") for _ in range(r.randint(1, 60)))
        assert [vocab[i] for i in m.ids(word)] == naive_merges(word, ranks)


def test_a_word_of_a_megabyte(spark):
    docs = table(spark, [(0, "ab" * (1 << 19), "en", "s"), (1, "word " * 200_000, "en", "s")])
    got = {r.doc_id: r for r in bpe.encode(docs, PATH).select("doc_id", "n_tokens", "ids").collect()}
    library = Tokenizer.from_file(PATH)
    assert got[0].ids == library.encode("ab" * (1 << 19), add_special_tokens=False).ids and got[1].n_tokens == 200_000


# 13 ------------------------------------------------------------------------------------------------------------------
def brute_collocations(rows, max_n, least, top):
    f, n = defaultdict(Counter), Counter()
    for _, t, lang, _ in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, max_n + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = {}
    for lang, counts in f.items():
        some = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in some.items():
            around = [b for q, b in some.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if any(100 * b >= 100 * a for b in around):
                continue
            score, _, left, right = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out[lang, rank] = (phrase.decode(), -a, left, right, n[lang], -score)
    return out


def phrase_rows():
    r = random.Random(13)
    words = ["the", "The", "of", "new", "york", "é", "\x00", "straße", "a-b", "'", " x", "ﬀ", "😀"]
    rows = []
    for i in range(260):
        w = [r.choice(words) for _ in range(r.randint(0, 40))]
        for _ in range(r.randint(0, 3)):
            w[r.randint(0, len(w)) : 0] = r.choice(["new york city hall", "of the new", "the the the the the the", "one two three four five six"]).split()
        text = "".join(x + r.choice([" ", "\t", "  ", " ", " ", ". ", ",", "\n", "\r\n", "!?"]) for x in w)
        rows.append((i, text, r.choice(["en", "en", "en", "de", None, ""]), "s"))
    return [*rows, *rows[:5], (None, None, "en", "s"), (8, "", None, "s"), (9, " . ,\n", "fr", "s"), (10, "alone", "es", "s"), (11, "z" * 100_000, "en", "s")]


@pytest.mark.parametrize("max_n, least, top, bytes_", [(5, 8, 2000, 32 << 20), (5, 3, 20, 8), (2, 5, 50, 1 << 10), (3, 6, 5, 64)])
def test_collocations(spark, max_n, least, top, bytes_):
    rows = phrase_rows()
    got = collocations.collocations(table(spark, rows).repartition(7), max_n, least, top=top, filter_bytes=bytes_).collect()
    found = {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got}
    assert len(got) == len(found) > 10 and found == brute_collocations(rows, max_n, least, top)


def test_collocations_of_nothing_and_of_large_numbers(spark):
    assert collocations.collocations(table(spark, [])).count() == 0
    assert collocations.collocations(table(spark, [(1, None, None, "s"), (2, "a b. a b", "en", "s")])).count() == 0
    text = "one two. " * 60_000 + "three. " * 4_000_000  # 1000 * a * n is over 64 bits from 10**18 on: here 2.5e14, scaled up below
    docs = table(spark, [(1, text, "en", "s")])
    got = collocations.collocations(docs, scale=10**9 - 1).collect()
    assert [(r.phrase, r.a, r.n, r.score) for r in got if r.phrase == "one two"] == [("one two", 60_000, 4_120_000, (10**9 - 1) * 60_000 * 4_120_000 // 60_000**2)]


def test_words_are_learned_once_and_as_the_library_says(monkeypatch):
    """250,000 words, more than were held before, in two pieces; then both again."""
    from brightweir.llm import words_bpe

    r, path = random.Random(3), public_tokenizers.path("word_bpe_49k.json")
    words = sorted({"".join(r.choices("abcdeilmnorstu", k=r.randrange(4, 10))) for _ in range(250_000)})
    words += ["été", "straße", "it's", "a1b2", "...x", "don't-", "x" * 300]
    pieces = [pa.array([" ".join(words[k::2]), None, "One, two; Été."]) for k in range(2)]
    encode = words_bpe.encoder.__wrapped__(path)
    learned, learn = [], encode._learn
    monkeypatch.setattr(encode, "_learn", lambda new: (learned.extend(new), learn(new)))
    got = [[x.tolist() for x in encode.encode(p)] for p in pieces * 2]
    assert got[:2] == got[2:] and len(learned) == len(set(learned)) > words_bpe.MOST_WORDS
    of_words = [e.ids for e in encode.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
    assert [g[0] for g in got[:2]] == [[i for ids in of_words[k::2] for i in ids] for k in range(2)]
    assert got[0][1] == [] and got[0][2] == encode.tokenizer.encode("One, two; Été.", add_special_tokens=False).ids
