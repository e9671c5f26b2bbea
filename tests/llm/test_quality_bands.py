"""Ordinary junk, half of it real words, is rejected by the perplexity bands; clean texts stay."""

import random

from brightweir.llm import quality

DOCS = "doc_id long, text string, lang string"


def test_ordinary_junk_is_rejected(spark):
    r = random.Random(2)
    letters = "etaoinshrdlu"
    lexicon = ["".join(r.choices(letters, weights=range(12, 0, -1), k=r.randint(2, 8))) for _ in range(1500)]
    share = [1 / (k + 5) for k in range(1500)]
    clean = [" ".join(r.choices(lexicon, share, k=r.randint(80, 200))) for _ in range(400)]
    junk = [" ".join(w if r.random() > 0.3 else "".join(r.sample(w, len(w))) for w in r.choices(lexicon, share, k=150)) for _ in range(8)]
    rows = [(i, t, "en") for i, t in enumerate(clean + junk)]
    out = quality.quality(spark.createDataFrame(rows, DOCS)).collect()
    got = {x.doc_id: x.kept for x in out}
    assert not any(x.base_failed for x in out)
    assert sum(not got[400 + i] for i in range(8)) >= 7 and sum(got[i] for i in range(400)) >= 396
