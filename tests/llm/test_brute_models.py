"""Models and scores against plain versions of them, written from their definitions."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from brightweir.llm import language_id, quality, secrets, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, (t, lang) in enumerate(rows)], DOCS)


# Kneser-Ney -----------------------------------------------------------------------------------------------------------
def symbols(text):
    flat = re.sub(r"[\t\n\x0b\x0c\r \x85\xa0]+", " ", text.lower())
    kind = lambda c: "0" if c in "0123456789" else "." if c in ".,;:!?" else "#" if c.isascii() and c.isprintable() and not c.isalnum() and c != " " else c
    return ("    " if not flat.startswith(" ") else "    ") + "".join(map(kind, flat))


class Brute:
    """Interpolated modified Kneser-Ney of characters, by recursion over strings."""

    def __init__(self, texts):
        c = Counter(s[i : i + 5] for t in texts if t for s in [symbols(t)] for i in range(len(s) - 4))
        self.c = {5: c}
        for k in (4, 3, 2, 1):
            self.c[k] = Counter(g[1:] for g in self.c[k + 1])
        self.follow = {k: defaultdict(list) for k in self.c}
        for k in self.c:
            for g, n in self.c[k].items():
                self.follow[k][g[:-1]].append(n)

    def off(self, k, n):
        many = [sum(v == j for v in self.c[k].values()) for j in (1, 2, 3, 4)]
        if not all(many):
            return (0, 0.5, 0.75, 1.0)[min(n, 3)]
        y = many[0] / (many[0] + 2 * many[1])
        return (0, *(min(max(j + 1 - (j + 2) * y * many[j + 1] / many[j], 0.05), j + 0.95) for j in range(3)))[min(n, 3)]

    def p(self, g):
        k = len(g)
        if k == 0:
            return 1 / (len(self.c[1]) + 1)
        after = self.follow[k].get(g[:-1])
        below = self.p(g[1:])
        if not after:
            return below
        n = self.c[k].get(g, 0)
        return (n - self.off(k, n) + sum(self.off(k, x) for x in after) * below) / sum(after)


@pytest.mark.parametrize("most", [1 << 30, 1])
def test_perplexity_against_recursion(spark, most):
    r = random.Random(3)
    known = ["the", "cat", "Sat,", "on", "a", "mat.", "über", "漢字", "12", "x|y"]
    rows = [(" ".join(r.choices(known, k=r.randint(1, 30))), r.choice(["en", "de"])) for _ in range(25)] + [(None, "en"), ("", "de"), ("\n\t ", "en"), ("q", "fr")]
    docs = table(spark, rows).select("doc_id", "lang", "text")
    models = quality.fit(docs.select("lang", "text"), 3)
    got = {x.doc_id: x.nll for x in quality.scored(docs, models, 3, most).collect()}
    brute = {lang: Brute([t for t, own in rows if own == lang]) for lang in ("en", "de", "fr")}
    for i, (t, lang) in enumerate(rows):
        if not t:
            assert got[i] == 0
            continue
        s = symbols(t)
        grams = [s[j : j + 5] for j in range(len(s) - 4)]
        want = -sum(math.log(brute[lang].p(g)) for g in grams) / len(grams)
        assert abs(got[i] - want) < 1e-4, (t, got[i], want)


def test_back_off_of_unseen_ngrams_sums_to_one():
    text = "the cat sat on the mat, the cat ran. " * 3 + "dogs bark at 12"
    keys, n = np.unique(quality.ngrams(text), return_counts=True)
    spread, kept, c = [], keys, n
    for k in (5, 4, 3):
        spread += [int((c == j).sum()) for j in range(1, 5)]
        kept, c = np.unique(quality.shorter(kept, k - 1), return_counts=True)
    model = quality.kneser_ney(keys, n, np.array(spread), kept, c)
    every = np.unique(quality.shorter(keys, 1))
    for context in ["the ", "cat ", "zzzz", " 000"]:
        codes = quality.ngrams(context + "a")[-1:] >> 12 << 12
        total = np.exp(quality.look_up(codes | every, model)).sum()
        # One symbol stands for all that the text lacks.
        assert 0.9 < total < 1.0001, (context, total)


# Secrets --------------------------------------------------------------------------------------------------------------
def base_by_hand(text):
    """Leftmost matches, one after another, for each kind on its own."""
    word, out = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-", []
    i = 0
    while i < len(text):
        for name in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text[i : i + len(name)]) == name:
                j = i + len(name)
                j += text[j : j + 1] in ('"', "'") and text[j : j + 1] != ""
                while text[j : j + 1] == " ":
                    j += 1
                if text[j : j + 1] not in (":", "=") or not text[j : j + 1]:
                    continue
                j += 1
                while text[j : j + 1] == " ":
                    j += 1
                j += text[j : j + 1] in ('"', "'") and text[j : j + 1] != ""
                k = j
                while k < len(text) and text[k] in word:
                    k += 1
                if k > j:
                    if k - j >= 12:
                        out.append((i, 0, k))
                    i = k - 1
                    break
        i += 1
    for kind, head, allowed, least in ((1, "AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 18), (2, "", "0123456789abcdef", 16)):
        i = 0
        while i < len(text):
            k = i + len(head)
            while k < len(text) and text[k] in allowed:
                k += 1
            if text.startswith(head, i) and k > i + len(head):
                if k - i >= least:
                    out.append((i, kind, k))
                i = k
            else:
                i += 1
    return sorted(out)


@pytest.mark.parametrize("seed", range(8))
def test_base_spans_by_hand(seed):
    r = random.Random(seed)
    parts = ["password", "TOKEN", "Api_key", "apikey", "secret", "passwd", "=", ":", " ", '"', "'", "AKIA", "AKIAABCDEFGHIJ0123", "0123456789abcdef", "deadbeef", "xY9+/_.=-", "é", "\n", "longvalue1234", "K", "ſecret"]
    text = "".join(r.choice(parts) for _ in range(300))
    base, every = secrets.Scanner().spans(text)
    assert base == base_by_hand(text)
    inside = [s for s in every if s[1] == 3]
    assert all(not any(x <= a and b <= y for x, _, y in base) for a, _, b in inside) and every == sorted(every)


def test_planted_keys_without_a_pattern_are_found(spark):
    r = random.Random(9)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    plain = "the quick brown fox jumps over internationalization 2024-01-02 path/to/file1 123e4567-e89b-12d3-a456-426614174000 ABCDEFGHIJ0123456789abcdefgh".split()
    texts = [" ".join(r.choices(plain, k=40)) for _ in range(200)]
    keys = ["".join(r.choices(alphabet, k=r.choice([32, 40, 64]))) for _ in range(100)]
    planted = [t + " " + k + " end" for t, k in zip(texts[:100], keys, strict=True)] + texts[100:]
    docs = table(spark, [(t, "en") for t in planted])
    got = {x.doc_id: x.n_entropy for x in secrets.find_secrets(docs).collect()}
    assert sum(got[i] > 0 for i in range(100)) >= 95 and sum(got[i] > 0 for i in range(100, 200)) == 0


def test_many_findings_in_one_text_take_linear_time():
    import time

    took = []
    for n in (2000, 8000):
        text = " ".join(f"{i:016x}" + " Xk9fQ2mZ7pLw4Rt8Vb3Ns6Yd" * (i % 2) for i in range(n))
        began = time.perf_counter()
        secrets.Scanner().spans(text)
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0] + 0.2


# Languages ------------------------------------------------------------------------------------------------------------
def test_language_scores_by_hand(spark):
    rows = [("Die Katze die Katze", "de"), ("the cat and the cat", "en"), ("le chat noir", "fr"), ("thecats katzen xq", None), ("und", None), ("ÄÖ the", None), (None, "xx"), ("123", "en")]
    docs = table(spark, rows)
    got = {x.doc_id: (x.lang_pred, x.score) for x in language_id.identify(docs, per_language=1 << 20).collect()}
    held = {x.doc_id for x in docs.where(F.coalesce(toxicity.fold(F.col("doc_id"), 3) == 1, F.lit(False))).collect()}
    words = [(w.lower(), lang) for i, (t, lang) in enumerate(rows) if t and lang and i not in held for w in re.findall(r"[^\W\d_]+", t)]
    languages = sorted({lang for _, lang in words})
    tables = {0: Counter(words)}
    for n in range(1, 5):
        tables[n] = Counter((f" {w} "[i : i + n], lang) for w, lang in words for i in range(len(w) + 3 - n))
    totals = {n: Counter() for n in tables}
    for n, c in tables.items():
        for (_, lang), k in c.items():
            totals[n][lang] += k

    def share(n, g):
        return [math.log(tables[n][g, x] / totals[n][x]) if tables[n][g, x] else language_id.PENALTY for x in languages] if any(tables[n][g, x] for x in languages) else None

    def of_word(w):
        if (s := share(0, w)) is not None:
            return s
        for n in range(4, 0, -1):
            own = [s for i in range(len(w) + 3 - n) if (s := share(n, f" {w} "[i : i + n])) is not None]
            if own:
                return [sum(x) / len(own) for x in zip(*own, strict=True)]
        return [language_id.PENALTY] * len(languages)

    for i, (t, _) in enumerate(rows):
        own = [of_word(w.lower()) for w in re.findall(r"[^\W\d_]+", t or "")]
        if not own:
            assert got[i] == ("und", 0.0)
            continue
        mean = [sum(x) / len(own) for x in zip(*own, strict=True)]
        z = [math.exp((m - max(mean)) * min(len(own), language_id.SURE)) for m in mean]
        assert got[i][0] == languages[mean.index(max(mean))] and abs(got[i][1] - 1 / sum(z)) < 1e-4, (t, got[i])


def test_a_rare_language_is_learned_and_ties_go_to_the_first(spark):
    rows = [("the cat sat on the mat", "en")] * 300 + [("gato negro", "es")] * 3 + [("same", "aa"), ("same", "bb")] * 3 + [("gato", None), ("same", None)]
    docs = table(spark, rows).withColumn("lang_pred", F.lit("clash"))
    got = {x.doc_id: x.lang_pred for x in language_id.predicted(docs, language_id.fit(docs, per_language=40)).collect()}
    assert got[len(rows) - 2] == "es" and got[len(rows) - 1] == "aa"
    assert language_id.identify(docs.limit(0)).count() == 0


# Toxicity -------------------------------------------------------------------------------------------------------------
def test_lengths_are_those_of_the_compressor():
    model = toxicity.Model(b" you awful person " * 20, b" quite ordinary words " * 20, *([np.zeros(1)] * 3), 0.0)
    cut = toxicity.windows(b"You awful person, these are quite ordinary words here today " * 3)
    one = lambda d, w: len(zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False).compress(w))
    assert model.differences(cut).tolist() == [one(model.ordinary, w) - one(model.toxic, w) for w in cut]


def test_training_bounds_and_edges(spark):
    r = random.Random(1)
    calm = "the quick brown fox jumps over a lazy dog near some river bank today".split()
    rude = ["idiot", "moron", "scum"]
    rows = [(" ".join(r.choices(calm, k=60) + (r.choices(rude, k=6) if i % 3 == 0 else [])), "en") for i in range(240)] + [(None, "en"), ("", "en"), ("idiot scum " * 200_000, "en")]
    docs = table(spark, rows).withColumn("toxicity", F.lit(5)).unionByName(table(spark, rows[:2]).withColumn("toxicity", F.lit(5)))
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(240)] + [(242, 1), (1, None), (None, 1)], "doc_id long, toxic int")
    out = toxicity.toxicity(docs, labels).collect()
    got = {x.doc_id: x for x in out}
    assert len(out) == 245 and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in out)
    told = [got[i].predicted == int(i % 3 == 0) for i in range(240) if got[i].held_out]
    assert np.mean(told) > 0.9 and got[242].predicted == 1 and got[240].score == got[241].score
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    assert toxicity.scored(docs, toxicity.train([])).select("toxicity").distinct().count() == 1


def test_cut_prefers_recall_within_its_slack():
    z = np.array([2.0, 1.0, -0.3, -0.4, -3.0])
    assert toxicity._cut(z, np.array([1, 1, 1, 0, 0]), np.ones(5)) == pytest.approx(-0.3)
    assert toxicity._cut(z, np.array([1, 1, 0, 0, 0]), np.ones(5)) == 0
    assert hashlib.sha256(b"").hexdigest()[:4] == "e3b0"
