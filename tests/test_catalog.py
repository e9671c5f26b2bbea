"""Catalog operators: every query with SQL against DuckDB, and edge cases of single operators."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from brightweir import catalog_queries, evidence_queries, ingest_queries, policy_queries  # noqa: F401 - the last three add their queries
from brightweir.functions import periods, text
from brightweir.operators import audit, search, snapshot, verdict

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _sorted(rows):
    return sorted(tuple((x is None, str(x)) for x in r) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(catalog_queries.QUERIES))
def test_query_matches_sql(spark, name):
    df = catalog_queries.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = df.select(*cols).collect()
    if name not in catalog_queries.ORACLE_SQL:
        assert got
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    r = con.execute(catalog_queries.ORACLE_SQL[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    assert _sorted(got) == _sorted([[row[names.index(c)] for c in cols] for row in r.fetchall()])


def test_age_verdicts(spark):
    rows = [(20, 19, 34), (40, 19, 34), (20, None, None), (20, 0, 0), (None, 19, 34), (20, None, 34), (50, 19, None)]
    df = spark.createDataFrame(rows, "v int, lo int, hi int")
    assert [r[0] for r in df.select(verdict.age(F.col("v"), F.col("lo"), F.col("hi"))).collect()] == ["match", "mismatch", "unknown", "unknown", None, "match", "match"]
    told = spark.createDataFrame([(0, 0, "연령 제한  없음"), (0, 0, "만 19세"), (None, 30, "제한 없음")], "lo int, hi int, t string")
    assert [r[0] for r in told.select(verdict.age(F.lit(40), F.col("lo"), F.col("hi"), F.col("t"))).collect()] == ["match", "unknown", "mismatch"]


def test_region_precedence(spark):
    tree = verdict.closure(spark.createDataFrame([("c", None), ("p", "c"), ("d", "p"), ("q", "c")], "code string, parent string"))
    policies = spark.createDataFrame([("a", "nationwide"), ("b", None), ("c", "regional"), ("d", "regional"), ("e", "regional"), ("f", "regional"), ("g", "regional")], "policy string, scope string")
    rules = spark.createDataFrame([("c", "include", "p"), ("d", "include", "c"), ("e", "include", "d"), ("f", "include", "q"), ("g", "include", "p"), ("g", "exclude", "p")], "policy string, relation string, code string")
    got = {r.policy: r.reason for r in verdict.region(policies, rules, tree, "p").collect()}
    assert got == {"a": "nationwide", "b": "policy_unknown", "c": "exact", "d": "ancestor", "e": "descendant", "f": "other_region", "g": "exclude"}


def test_upsert_outcomes_and_null_keys(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "z"), (4, "n"), (None, "q"), (3, None)], "k int, v string")
    got = _sorted(snapshot.upsert(a, b, ["k"], ["v"]).collect())
    assert got == _sorted([(1, "x", "unchanged"), (2, "z", "updated"), (3, None, "unchanged"), (4, "n", "inserted"), (None, "q", "inserted")])


def test_transitions_with_missing_sides(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, s string"), spark.createDataFrame([(2, "x"), (3, "x")], "k int, s string")
    got = {r.change: (r.n, r.allowed) for r in audit.transitions(a, b, "k", "s", {("y", "x")}).collect()}
    assert got == {"x->none": (1, False), "y->x": (1, True), "none->x": (1, False)}


def test_urls(spark):
    urls = ["HTTPS://Example.org/A/?b=2&utm_source=x&a=1#top", "http://x.org", "http://x.org/?utm_a=1", None]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(text.canonical_url(F.col("u"))).collect()] == ["https://example.org/A?a=1&b=2", "http://x.org", "http://x.org", None]


def test_visible_text_drops_scripts():
    assert text.visible("<p>a<script>'</p>'</script></p><div>b &amp; c</div><style>x</style>") == "a b & c"


def test_anchors_and_wildcards(spark):
    assert search.anchors(["지원", "rent", " RENT "]) == ["rent"]
    assert search.anchors(["지원"], "지원") == ["지원"]
    df = spark.createDataFrame([("100% rent",), ("1000 rent",), (None,)], "t string")
    assert search.candidates(df, ["t"], ["100%rent"]).count() == 2
    assert search.candidates(df, ["t"], []).count() == 3


def test_period_and_grid(spark):
    df = spark.sql("SELECT DATE'2026-01-01' s, DATE'2026-02-28' e, DATE'2026-02-28' t")
    r = df.select(periods.period_status(F.col("s"), F.col("e"), F.col("t")), periods.deadline_kind(F.col("e"), F.col("t")), F.size(periods.month_grid(F.col("t")))).first()
    assert tuple(r) == ("open", "today", 42)
