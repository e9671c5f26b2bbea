"""Rows that an explode makes many of are not sent to every worker, and buckets are compared several at once."""

import random

from brightweir.llm import simhash
from brightweir.operators.audit import met


def test_rows_for_each_band_are_no_broadcast(spark, capsys):
    r = random.Random(5)
    bases = [r.getrandbits(63) for _ in range(700)]
    every = {x ^ sum(1 << b for b in r.sample(range(63), k)) for x in bases for k in (0, r.randrange(1, 12))}
    links = simhash.near_links(spark.createDataFrame([(x,) for x in sorted(every)] * 2, "fp long").distinct(), 7)
    got = {(min(x), max(x)) for x in links.collect()}
    assert all(a != b and (a ^ b).bit_count() <= 7 for a, b in got)
    assert got == {(a, b) for a in every for b in every if a < b and (a ^ b).bit_count() <= 7}  # pairs alone, so a forest has all of them
    links.explain("formatted")
    assert "BroadcastHashJoin" not in capsys.readouterr().out  # before, the bands' rows were as small to Spark as the fingerprints


def test_the_side_that_goes_to_all_parts_is_no_broadcast(spark, capsys):
    left = spark.range(500).selectExpr("id", "id % 7 AS k")
    right = left.groupBy("k").count()
    rows = met(left, right, "k")
    assert sorted(map(tuple, rows.collect())) == sorted((x % 7, x, len(range(x % 7, 500, 7))) for x in range(500))
    rows.explain("formatted")
    assert "BroadcastHashJoin" not in capsys.readouterr().out
