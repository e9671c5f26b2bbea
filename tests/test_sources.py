"""Raw store, readers, parsers of free text and releases."""

import datetime

import pytest
from pyspark.sql import functions as F

from brightweir.functions import parsing
from brightweir.operators import release
from brightweir.sources import raw


def _raw(spark):
    t = datetime.datetime(2026, 1, 1)
    rows = [("s1", "l1", "list_response", None, None, b"<a/>", t), ("s1", "i1", "list_item", "x", "l1", b'{"n": 1}', t), ("s1", "i2", "list_item", "x", "l1", b'{"n": 2}', t + datetime.timedelta(1)), ("s2", "d1", "detail_response", "y", "gone", b"{bad", t)]
    df = spark.createDataFrame(rows, "source_id string, document_id string, document_role string, external_id string, parent_document_id string, body binary, collected_at timestamp")
    return raw.sealed(df.withColumns({"source_url": F.lit("http://x"), "raw_format": F.lit("json")}), "body")


def test_raw_store(spark, tmp_path):
    raw.save(_raw(spark), f"{tmp_path}/raw")
    with pytest.raises(Exception, match="already exists"):
        raw.save(_raw(spark), f"{tmp_path}/raw")
    df = raw.load(spark, f"{tmp_path}/raw")
    assert df.count() == 4 and raw.load(spark, f"{tmp_path}/raw", "s1").count() == 3
    assert df.where(F.size(raw.faults()) > 0).count() == 0
    assert [r.f for r in df.withColumn("byte_length", F.lit(0).cast("long")).select(raw.faults().alias("f")).distinct().collect()] == [["length"]]
    assert [r.document_id for r in raw.orphans(df).collect()] == ["d1"]
    assert {r.document_id for r in raw.newest(df).collect()} == {"l1", "i2", "d1"}
    assert {r.document_id: r.item.n if r.item else None for r in raw.json_items(df.where("document_id <> 'l1'"), "n int").collect()} == {"i1": 1, "i2": 2, "d1": None}


def test_xml_csv_and_logs(spark, tmp_path):
    df = raw.sealed(spark.createDataFrame([(bytearray(b"<r><v>1</v></r>"),)], "body binary"), "body")
    assert raw.xml_items(df, "v int", "r").first().item.v == 1
    (tmp_path / "a.csv").write_text("a,b\n1,2\n")
    assert raw.csv_items(spark, f"{tmp_path}/a.csv", ["a", "b"]).count() == 1
    with pytest.raises(ValueError):
        raw.csv_items(spark, f"{tmp_path}/a.csv", ["b", "a"])
    (tmp_path / "x.log").write_text('{"timestamp": "t", "level": "error", "event": "boom"}\nnot json\n{"event": "ok"}\n')
    assert raw.log_events(spark, f"{tmp_path}/x.log").count() == 2
    assert raw.log_events(spark, f"{tmp_path}/x.log", "ERROR", "oo").count() == 1


PERIODS = [
    (None, None, None, None, None, None),
    ("상시 모집", None, None, "always", "open", None),
    ("접수 마감", None, None, None, "closed", None),
    ("예산 소진 시까지", None, None, "until_budget_exhausted", None, None),
    ("특정기간", None, None, "fixed_period", None, None),
    ("2026-02-30", None, None, None, None, "invalid_application_date"),
    ("2026. 1. 5 ~ 2026/02/01", "2026-01-05", "2026-02-01", "fixed_period", "open", None),
    ("20260301~20260201", None, None, None, None, "invalid_application_date_order"),
    ("2026.1.1까지", None, "2026-01-01", "fixed_period", "closed", None),
    ("2026.3.1", "2026-03-01", None, "fixed_period", "scheduled", None),
    ("2025년 12월 ~ 2026년 2월", "2025-12-01", "2026-02-28", "fixed_period", "open", None),
    ("2026.1~3", "2026-01-01", "2026-03-31", "fixed_period", "open", None),
    ("2026년 13월 ~ 14월", None, None, None, None, "invalid_application_date"),
    ("문의", None, None, None, None, "unparsed_application_period"),
]


def test_periods(spark):
    df = spark.createDataFrame([(i, p[0]) for i, p in enumerate(PERIODS)], "i int, t string")
    got = {r.i: r.p for r in df.select("i", parsing.period(F.col("t"), F.lit("2026-01-15").cast("date")).alias("p")).collect()}
    for i, want in enumerate(PERIODS):
        assert tuple(None if x is None else str(x) for x in got[i]) == want[1:], want[0]


def test_ages(spark):
    rows = [("만 19세 ~ 34세", 19, 34, None), ("19세 이상 34세 이하", 19, 34, None), ("39세 이하", None, 39, None), ("18세 이상", 18, None, None), ("40~20", None, None, "invalid_age_range"), ("청년 3명", None, None, "unparsed_age_condition"), ("제한 없음", None, None, None), (None, None, None, None), ("0~0", 0, 0, None)]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, t string")
    got = {r.i: tuple(r.a) for r in df.select("i", parsing.age_limits(F.col("t")).alias("a")).collect()}
    assert [got[i] for i in range(len(rows))] == [r[1:] for r in rows]
    asked = spark.createDataFrame([("만 25세 월세",), ("27살",), ("만 30",), ("200세",), ("주택",)], "t string")
    assert [r[0] for r in asked.select(parsing.asked_age(F.col("t"))).collect()] == [25, 27, 30, None, None]
    words = spark.createDataFrame([("청년주택 지원",), ("취업",), (None,)], "t string")
    assert [r[0] for r in words.select(parsing.keyword(F.col("t"), {"주택": "housing", "청년주택": "never", "취업": "employment"})).collect()] == ["housing", "employment", None]


def test_release(spark, tmp_path):
    root = f"{tmp_path}/rel"
    one = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    release.install(one, root, "v1", ["k"])
    release.install(one.where("k = 1"), root, "v2", ["k"])
    assert release.active(spark, root).count() == 1
    with pytest.raises(ValueError):
        release.install(one.unionByName(one), root, "v3", ["k"])
    assert release.active(spark, root).count() == 1
    with pytest.raises(Exception, match="already exists"):
        release.install(one, root, "v1", ["k"])
