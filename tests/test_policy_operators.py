"""Edge cases of search, regions, normalisation, decisions, gates and display."""

import datetime

import pytest
from pyspark.sql import functions as F

from brightweir.functions import text
from brightweir.operators import decide, display, gates, integrity, normalize, search, snapshot, validate, verdict


def one(spark, *cols):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def test_closure_has_no_depth_limit_and_refuses_cycles(spark):
    chain = spark.createDataFrame([(f"c{i:02}", f"c{i - 1:02}" if i else None) for i in range(13)], "code string, parent string")
    got = verdict.closure(chain)
    assert got.where("code = 'c12'").count() == 13 and got.agg(F.max("distance")).first()[0] == 12
    loop = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a")], "code string, parent string")
    with pytest.raises(ValueError, match="cycle"):
        verdict.closure(loop)
    assert sorted(r.code for r in integrity.cycles(loop).collect()) == ["a", "b"]
    assert integrity.cycles(chain.where("parent IS NOT NULL")).count() == 0
    assert verdict.closure(chain.limit(0)).count() == 0


def test_region_of_states_that_are_not_matched(spark):
    tree = verdict.closure(spark.createDataFrame([("c", None), ("p", "c")], "code string, parent string"))
    policies = spark.createDataFrame([("n", "nationwide"), ("r", "regional"), ("u", "unknown")], "policy string, scope string")
    rules = spark.createDataFrame([("r", "include", "p")], "policy string, relation string, code string")
    for query, state, want in (("x", "matched", "query_unmapped"), ("p", "ambiguous", "query_ambiguous"), (None, "matched", "query_unmapped"), ("p", "matched", "exact")):
        got = {r.policy: r.reason for r in verdict.region(policies, rules, tree, query, state).collect()}
        assert got == {"n": "nationwide", "r": want, "u": "policy_unknown"}


def test_terms_fold_width_and_case(spark):
    df = spark.createDataFrame([("ＡＢＣ straße",), ("a  b c",), (None,), ("STRASSE",)], "t string").withColumn("f", text.folded(F.col("t")))
    got = [r[0] for r in df.select(text.term_hits(F.col("f"), ["abc", "Straße", " "])).collect()]
    assert got == [["abc", "strasse"], ["abc"], [], ["strasse"]]
    assert search.distinct_terms([" a", "A", "", "b"]) == ["a", "b"]


def test_projection_counts_a_fragment_once(spark):
    df = spark.createDataFrame([(1, " Rent  help ", ["a", " a", "ｂ"], "Rent help"), (2, None, None, None), (3, "", [], "x")], "id int, title string, categories array<string>, summary string")
    got = {r.id: (r.title_text, r.keyword_text, r.search_text) for r in search.search_document(df).collect()}
    assert got == {1: ("Rent help", "a b", "Rent help a b"), 2: ("", "", ""), 3: ("", "", "x")}


def test_rows_without_projection_keep_the_plain_score(spark):
    cols = "id int, title string, summary string, quality string, status string, age_min int, age_max int, age_text string, categories array<string>, regions array<string>, title_text string, keyword_text string, summary_text string, eligibility_text string, support_text string, search_text string"
    rows = [(1, "rent", None, "valid", None, None, None, None, [], [], None, None, None, None, None, None), (2, "rent", None, "valid", "open", 0, 0, None, ["housing"], [], "rent", "", "", "", "", "rent"), (3, "rent", None, "valid", "closed", None, None, None, [], [], "rent", "", "", "", "", "rent")]
    got = {r.id: (r.score, r.status_rank, r.age_verdict) for r in search.evaluate(spark.createDataFrame(rows, cols), search.Request(terms=["rent"], age=30)).collect()}
    assert got == {1: (1.0, 2, "unknown"), 2: (4.0, 0, "unknown")}
    assert search.Request.merged({"age": 20, "status": "open"}, {"age": 30, "status": None}) == search.Request(age=30, status="open")


def test_recommendation_by_status(spark):
    df = spark.createDataFrame([("open",), ("closed",), ("scheduled",), (None,)], "s string")
    m = F.lit("match")
    for want, gone in ((None, [False, True, False, False]), ("open", [False, True, True, True]), ("upcoming", [True, True, False, True])):
        assert [r[0] for r in df.select(search.recommendation(m, m, m, F.col("s"), want)[0]).collect()] == gone


def test_visible_text():
    assert text.visible("<p>a<b>b</b></p><h1>c</h1>d<!-- x --> &lt;e&gt;<br/>f") == "ab cd <e> f"
    assert text.visible("x<script>if (a<b) {}</SCRIPT >y<style>z") == "xy"
    assert text.visible("<script>") is None and text.visible("1 < 2") == "1 < 2"


def test_normalisers_of_nulls_and_blanks(spark):
    none = F.lit(None).cast("string")
    today = F.lit("2026-01-15").cast("date")
    got = one(spark, normalize.categories(none), normalize.region_names(none), normalize.code_evidence(none), normalize.availability(none, today), normalize.supplemental_availability(none, today), normalize.without_suffix(F.lit("도")), normalize.source_text(none), normalize.public_contact(F.lit("담당자")), normalize.safe_url(none), normalize.url_identity(none))
    assert [tuple(x) if isinstance(x, tuple) else x for x in got] == [([], False), ([], None), ("unknown", []), ("review_required", "application_period_missing"), "unknown", None, None, None, None, None]
    assert one(spark, normalize.availability(F.lit("2026년 13월 1일"), today)["reason"], normalize.availability(none, today, F.lit(True))["state"], normalize.availability(F.lit("2026.1.1"), today)["state"]) == ("application_period_invalid", "open", "closed")
    assert one(spark, normalize.has_zone(F.lit("2026-01-01T00:00:00")), normalize.has_zone(F.lit("2026-01-01T00:00:00+09:00")).isNotNull(), normalize.preferred(F.lit(" "), F.lit("b"))) == (None, True, "b")
    labels = F.create_map(F.lit("a"), F.lit(" "), F.lit("b"), F.lit("x"))
    assert one(spark, *[normalize.observation(labels, k) for k in "abc"]) == ("label_present_value_empty", "value_extracted", "label_not_found")


def test_mentions_without_names(spark):
    q = spark.createDataFrame([(1, "abc"), (2, ""), (3, None)], "key int, text string")
    names = spark.createDataFrame([("bc", 1), ("abcd", 1)], "name string, tier int")
    assert sorted((r.key, r.name) for r in normalize.mention(q, names).collect()) == [(1, "bc"), (2, None), (3, None)]
    assert normalize.mention(q, names.limit(0)).where("name IS NOT NULL").count() == 0
    assert {r.key: r.state for r in normalize.resolve(q.withColumnRenamed("text", "name"), names.selectExpr("name", "'x' code")).collect()} == {1: "unmapped", 2: "unmapped", 3: "unmapped"}


def test_region_rules(spark):
    kind = "array<struct<relation: string, resolution: string, scheme: string, code: string, source_code: string, source_text: string>>"
    rules = [("include", "matched", "s", "1", None, None), ("include", "matched", "s", "1", None, None), ("exclude", "matched", "s", "1", None, None), ("include", "matched", "s", None, None, None), ("include", "unmapped", "s", None, None, None)]
    df = spark.createDataFrame([(rules, "unknown"), ([], "regional"), (None, "nationwide")], f"r {kind}, s string")
    got = [{x.split("|")[1] for x in r[0]} for r in df.select(validate.region_issues(F.col("r"), F.col("s"))).collect()]
    assert got[0] == {"matched_region_reference", "duplicate_region_relation", "unresolved_canonical_region", "missing_region_evidence", "unknown_with_matched_region", "region_include_exclude_conflict"}
    assert got[1:] == [{"regional_without_include"}, set()]


def test_provenance(spark):
    t = datetime.datetime(2026, 1, 1)
    df = spark.createDataFrame([([("a", t), ("a", t)], t), ([], t), ([("a", t)], None)], "p array<struct<id: string, collected_at: timestamp>>, c timestamp")
    assert [r[0] for r in df.select(validate.provenance_faults(F.col("p"), F.col("c"))).collect()] == [["provenance_id_repeated"], ["provenance_missing", "collected_at_differs"], ["collected_at_differs"]]


def test_duplicates_without_a_baseline_and_contained_titles(spark):
    ids = spark.createDataFrame([(1,)], "id int")
    assert decide.duplicate_decisions(ids, None).first().reason == "aggregator_baseline_unavailable"
    a = spark.createDataFrame([(1, "abcde"), (2, "abcd"), (3, "xxabcdexx"), (4, "abcde")], "id int, key string")
    assert sorted(tuple(r) for r in decide.contained_titles(a, a).collect()) == [(1, 3), (3, 1), (3, 4), (4, 3)]


def test_taxonomy(spark):
    assert one(spark, F.array_join(decide.taxonomy(F.lit("가족돌봄청년rotc")), ",")) == ("care_independence/가족돌봄청년,cohort_military/ROTC,direct/청년",)


def test_the_day_of_an_instant_in_a_zone(spark):
    from brightweir.functions import periods

    late = F.lit("2026-01-14 16:30:00").cast("timestamp")
    assert one(spark, periods.day(late), periods.day(late, "Asia/Seoul")) == (datetime.date(2026, 1, 14), datetime.date(2026, 1, 15))


def test_gates(spark):
    assert one(spark, gates.lifecycle_complete(F.lit(True), F.lit(0), F.lit(True), F.lit(None), F.lit(0), F.lit(0)), gates.lifecycle_complete(F.lit(True), F.lit(1), F.lit(True), F.lit(0), F.lit(0), F.lit(0))) == (True, False)
    log = spark.createDataFrame([(1, 2, "claim"), (1, 1, "enqueue"), (2, 1, "claim"), (3, 1, "nonsense")], "run int, seq int, step string")
    assert {r.run: (r.state, r.allowed) for r in gates.run_log(log).collect()} == {1: ("running", True), 2: ("running", False), 3: ("none", False)}
    pages = spark.createDataFrame([("s", 1, 5, 4, 9, True), ("t", 1, 0, 4, None, False)], "source string, page int, n int, page_size int, total int, has_next boolean")
    assert sorted(tuple(r) for r in gates.pagination_blockers(pages, 1).collect()) == [("s", "page_size_drifted"), ("s", "safety_limit"), ("t", "page_empty"), ("t", "total_missing")]
    slots = spark.createDataFrame([("f", "a"), ("f", "b"), ("g", "odd")], "field string, state string")
    assert {r.field: r.reconciled for r in gates.field_states(slots, ("a", "b")).collect()} == {"f": True, "g": False}
    assert gates.criteria(slots, {"named": F.col("state") != "odd", "any": F.lit(True)}).first().blockers == "named"


def test_merged_details(spark):
    df = spark.createDataFrame([("p", 2, "late", "unknown", ["b"]), ("p", 1, " ", "closed", ["a", "b"]), ("q", 1, None, None, None)], "id string, at int, text string, state string, groups array<string>")
    assert {r.id: (r.text, r.state, r.groups) for r in snapshot.merged(df, "id", ["at"], ["text"], "state", "groups").collect()} == {"p": ("late", "closed", ["a", "b"]), "q": (None, "unknown", [])}


def test_orders_of_titles(spark):
    df = spark.createDataFrame([("나", 1), ("가", 2), ("b", 3), ("나", 0), ("가나", 4), ("A", 5)], "title string, id long")
    assert [(r.title, r.id) for r in df.orderBy(*display.client_order("title_asc")).collect()] == [("가", 2), ("가나", 4), ("나", 0), ("나", 1), ("A", 5), ("b", 3)]
    assert [r.id for r in df.orderBy(*display.client_order("other")).collect()] == list(range(6))


def test_display(spark):
    assert display.page_strip(5, 10) == [1, None, 3, 4, 5, 6, 7, None, 10] and display.page_strip(1, 1) == [1]
    assert display.search_state({"page": "-3", "size": "900", "age": "x", "sort": "bad"}, ("title_asc",)) == {"page": 1, "size": 100, "age": None, "sort": "default"}
    none = F.lit(None).cast("string")
    day = F.lit(None).cast("date")
    assert one(spark, display.period_card(day, day, none, F.lit("20260101 - 2026-02-01" + " x" * 30)), display.badge(none, none, none, F.lit(False)), F.array_join(display.badges(F.lit("open"), F.lit("fixed_period"), F.lit("partial"), F.lit(True)), "/")) == (("2026.01.01 - 2026.02.01" + " x" * 30)[:48] + "…", "정책", "기간 모집/정보 미확인/마감임박/모집중")
    df = spark.createDataFrame([("나",), ("가",), ("b",)], "title string").selectExpr("title", "1 id")
    assert {r.title for r in df.orderBy(*display.client_order("title_asc")).collect()} == {"가", "나", "b"}
