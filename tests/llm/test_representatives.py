"""Which rows stay where ids are null or repeated."""

import random

import pytest

from brightweir.llm import near_copies, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("of", [simhash.representatives, near_copies.representatives])
def test_null_and_repeated_ids(spark, of):
    r = random.Random(8)
    a, b, c, d, e, f = (" ".join(f"w{r.randrange(5000)}" for _ in range(60)) for _ in range(6))
    rows = [(1, a), (2, a), (2, b), (None, a), (None, c), (None, d), (5, e), (5, f), (5, e), (9, f), (None, c)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    got = sorted((x.doc_id or 0, x.text) for x in of(docs).collect())
    assert got == sorted([(1, a), (2, b), (0, c), (0, d), (5, e), (5, f)])
