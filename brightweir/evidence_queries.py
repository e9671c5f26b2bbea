"""Registered queries of the operators in ``evidence``, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brightweir.catalog_queries import _query, _tree
from brightweir.functions import text
from brightweir.operators import audit, evidence, verdict
from brightweir.session import table


_NAMES = evidence.REQUIRED
_UNSURE = ", ".join(f"CASE WHEN k // {2**i} % 3 = 1 THEN '{n}_unconfirmed' END" for i, n in enumerate(_NAMES))


@_query(f"""WITH c AS (SELECT c_custkey AS k, CASE WHEN c_acctbal < 0 THEN 'closed' WHEN c_mktsegment = 'BUILDING' THEN 'dated' WHEN c_nationkey = 3 THEN NULL ELSE 'open' END AS a, concat_ws('+', {_UNSURE}) AS missing,
  c_custkey % 11 = 1 OR c_custkey % 13 = 2 AS drift FROM customer),
r AS (SELECT k, CASE WHEN k % 7 = 0 THEN 'failed/evidence_contract_missing' WHEN drift THEN 'failed/evidence_contract_drift' WHEN a = 'closed' THEN 'closed/application_closed' WHEN a IS NULL OR a <> 'open' THEN 'review/application_availability_unconfirmed'
  WHEN missing <> '' THEN 'review/' || missing ELSE 'accepted/minimum_official_evidence_confirmed' END AS x FROM c) SELECT k AS id, split_part(x, '/', 1) AS outcome, split_part(x, '/', 2) AS reason FROM r""")
def supplemental_decisions(spark, d):
    """Every combination of unconfirmed evidence, availability by real columns, maps that lack a name or have one too many."""
    k = F.col("c_custkey")
    state = lambda i: F.when(F.floor(k / 2**i) % 3 == 1, F.when(k % 2 == 0, "unknown")).otherwise("confirmed")
    whole = F.create_map(*[x for i, n in enumerate((*_NAMES, "application_availability")) for x in (F.lit(n), F.lit("unknown") if n == "application_availability" else state(i))])
    gone = F.element_at(F.array(*map(F.lit, _NAMES)), (k % 5 + 1).cast("int"))
    told = F.when(k % 7 != 0, F.when(k % 11 == 1, F.map_filter(whole, lambda n, _: n != gone)).when(k % 13 == 2, F.map_concat(whole, F.create_map(F.lit("more"), F.lit("confirmed")))).otherwise(whole))
    a = F.when(F.col("c_acctbal") < 0, "closed").when(F.col("c_mktsegment") == "BUILDING", "dated").when(F.col("c_nationkey") != 3, "open")
    rows = table(spark, d, "customer").select(k.alias("id"), told.alias("e"), a.alias("a"))
    outcome, reason = evidence.supplemental(F.col("a"), F.col("e"))
    return rows.select("id", outcome.alias("outcome"), reason.alias("reason"))


@_query("""SELECT c_custkey AS id, ['exact_duplicate', 'exact_duplicate', 'review_required', 'not_assessed', 'exact_duplicate', 'review_required', 'potentially_new'][c_custkey % 7 + 1] AS outcome, ['aggregator_external_id_match', 'aggregator_external_id_match+title_conflict', 'direct_id_missing_from_baseline', 'excluded', 'canonical_url_match', 'normalized_title_match_only', 'no_exact_id_url_or_title_match'][c_custkey % 7 + 1] AS reason FROM customer""")
def inventory_duplicates(spark, d):
    k, n = (F.col("c_custkey") % 7).cast("int"), F.col("c_custkey").cast("string")
    key = lambda tag: F.concat(F.lit(tag), n)
    c = table(spark, d, "customer")
    base = c.where("c_custkey % 7 <> 6").select(key("b").alias("id"), F.when(k.isin(0, 3, 4, 5), key("t")).otherwise(key("other")).alias("title_key"), F.when(k.isin(3, 4), key("u")).alias("url"))
    mine = c.select(F.col("c_custkey").alias("id"), F.when(k == 3, "excluded").otherwise("candidate").alias("status"), F.when(k.isin(0, 1), key("b")).when(k == 2, key("none")).alias("direct"), F.when(k.isin(3, 4), key("u")).alias("url"), key("t").alias("title_key"))
    return evidence.inventory_duplicates(mine, base)


_SEEN = ("value_extracted", "label_present_value_empty", "label_not_found", "odd")


def _observed(i: int, f: str) -> str:
    status, label = f"k // {4**i} % 4", f"k // {i + 5} % 3"
    return f"CASE WHEN k // 7 % 9 = {i} OR {status} = 3 OR {label} = 2 OR ({status} = 0) <> (k // {i + 3} % 2 = 0) OR ({status} = 2) <> ({label} = 0) THEN '{f}' END"


@_query(f"""WITH o AS (SELECT o_orderkey AS k FROM orders) SELECT k AS id, CASE WHEN k % 17 = 0 THEN '' ELSE concat_ws(',', {", ".join(_observed(i, f) for i, f in enumerate("abc"))}, CASE WHEN k % 11 = 0 THEN 'unknown_field' END) END AS faults FROM o""")
def observation_faults(spark, d):
    """Status, label and value of three fields, each by digits of its own."""
    k = F.col("o_orderkey")
    at = lambda n, m: F.floor(k / n) % m

    def seen(i: int):
        status = F.element_at(F.array(*map(F.lit, _SEEN)), (at(4**i, 4) + 1).cast("int"))
        label = F.when(at(i + 5, 3) == 1, "Label").when(at(i + 5, 3) == 2, " ")
        return F.struct(F.when(at(7, 9) != i, status).alias("status"), label.alias("label"))

    fields = list("abc")
    own = F.create_map(*[x for i, f in enumerate(fields) for x in (F.lit(f), seen(i))])
    own = F.map_filter(own, lambda f, o: o["status"].isNotNull())
    more = F.map_concat(own, F.create_map(F.lit("z"), F.struct(F.lit("odd").alias("status"), F.lit("z").alias("label"))))
    values = F.create_map(*[x for i, f in enumerate(fields) for x in (F.lit(f), F.when(at(i + 3, 2) == 0, "v"))])
    told = F.when(k % 17 != 0, F.when(k % 11 == 0, more).otherwise(own))
    return table(spark, d, "orders").select(k.alias("id"), F.array_join(evidence.observation_faults(told, values, fields), ",").alias("faults"))


_SCOPE = ("jurisdiction", "operator", "channel")
_TOLD = {f: f"CASE k // {4**i} % 4 WHEN 1 THEN 'city' WHEN 2 THEN ' city' WHEN 3 THEN '  ' END" for i, f in enumerate(_SCOPE)}
_LOCATED = {f: f"k // {i + 3} % 2 = 0" for i, f in enumerate(_SCOPE)}


@_query(f"""WITH o AS (SELECT o_orderkey AS k FROM orders), v AS (SELECT k, {", ".join(f"{x} AS {f}" for f, x in _TOLD.items())} FROM o)
SELECT k AS id, concat_ws(',', {", ".join(f"CASE WHEN {f} <> trim({f}) THEN '{f}:text' END" for f in _SCOPE)}, {", ".join(f"CASE WHEN trim({f}) = '' THEN '{f}:blank' END" for f in _SCOPE)}, {", ".join(f"CASE WHEN ({f} IS NOT NULL) <> ({_LOCATED[f]}) THEN '{f}:locator' END" for f in _SCOPE)}, CASE WHEN k % 13 = 0 THEN 'locator:unknown' END) AS faults FROM v""")
def scope_contracts(spark, d):
    """Values and locators of three columns, each by digits of its own."""
    k = F.col("o_orderkey")
    at = lambda n, m: F.floor(k / n) % m
    value = lambda i: F.when(at(4**i, 4) == 1, "city").when(at(4**i, 4) == 2, " city").when(at(4**i, 4) == 3, "  ")
    locators = F.map_filter(F.create_map(*[x for i, f in enumerate((*_SCOPE, "other")) for x in (F.lit(f), F.when(k % 13 == 0 if f == "other" else at(i + 3, 2) == 0, f"//{f}"))]), lambda _, v: v.isNotNull())
    rows = table(spark, d, "orders").select(k.alias("id"), *[value(i).alias(f) for i, f in enumerate(_SCOPE)], locators.alias("locators"))
    return rows.select("id", F.array_join(evidence.scope_faults(list(_SCOPE), F.col("locators")), ",").alias("faults"))


@_query("""SELECT 'code' AS kind, 'n' || n_nationkey AS value FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 'code', 'r2' UNION ALL SELECT 'alias', n_name FROM nation WHERE n_regionkey = 2 AND n_nationkey <> 7""")
def territories(spark, d):
    """Codes and names under one region; a name that leads to two codes is none."""
    names = table(spark, d, "nation").select(F.col("n_name").alias("alias"), F.concat(F.lit("n"), "n_nationkey").alias("code"))
    twice = spark.createDataFrame([("NATION_7", "n8")], "alias string, code string")
    codes, aliases = evidence.territory(verdict.closure(_tree(spark, d)), names.unionByName(twice), "r2")
    return codes.select(F.lit("code").alias("kind"), F.col("code").alias("value")).unionByName(aliases.select(F.lit("alias").alias("kind"), F.col("alias").alias("value")))


@_query("""SELECT o_orderkey AS id, CASE k WHEN 0 THEN 'hold_review' WHEN 1 THEN 'exclude_invalid' WHEN 2 THEN 'exclude_duplicate' WHEN 3 THEN 'promote_partial' ELSE 'hold_review' END AS outcome, CASE k WHEN 0 THEN 'youth_target_unconfirmed' WHEN 1 THEN 'normalized_program_invalid' WHEN 2 THEN 'duplicate_confirmed' WHEN 3 THEN 'all_admission_conditions_satisfied' ELSE 'normalization_contract_not_satisfied' END AS reason, CASE k WHEN 0 THEN 1 ELSE 2 END AS round FROM (SELECT *, o_orderkey % 5 AS k FROM orders)""")
def review_rounds(spark, d):
    k = (F.col("id") % 5).cast("int")
    ids = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    good = F.array(F.lit("source_region_confirmed"), F.lit("application_period_open"))
    none = F.array().cast("array<string>")
    mine = ids.select("id", F.lit(True).alias("identity_valid"), F.lit("review").alias("checkpoint"), F.lit("open").alias("application"), F.when(k == 0, none).otherwise(F.array(F.lit("청년"))).alias("markers"), good.alias("original"), none.alias("current"))
    told = ids.where(k != 4).select("id", F.when(k == 1, "invalid").otherwise("valid").alias("normalization"), F.lit("sha256:x").alias("fingerprint"))
    twice = ids.select("id", F.when(k == 2, "excluded_intra_batch_duplicate").otherwise("accepted_regional").alias("duplicate"))
    return evidence.review(mine, told, twice)


@_query("""SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 17 = 0 OR o_orderkey % 23 = 0""")
def replayed_decisions(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("s"))
    new = o.where("id % 23 <> 0").withColumn("s", F.when(F.col("id") % 17 == 0, "X").otherwise(F.col("s")))
    return evidence.replay_differs(o, new, ["id"], ["s"])


@_query("""SELECT n_nationkey AS scenario, CASE WHEN n_nationkey % 4 <> 0 THEN CAST(n_nationkey AS INT) END AS rank, CASE n_nationkey % 4 WHEN 0 THEN 'not_found' WHEN 1 THEN CASE WHEN n_nationkey > 10 THEN 'rank' ELSE '' END WHEN 2 THEN CASE WHEN n_nationkey > 10 THEN 'rank,verdict:age' ELSE 'verdict:age' END ELSE CASE WHEN n_nationkey > 10 THEN 'rank' ELSE '' END END AS blockers FROM nation""")
def acceptance_scenarios(spark, d):
    k = F.col("n_nationkey")
    n = table(spark, d, "nation").select(k.alias("scenario"), (k * 10).alias("id"), k.alias("rank"))
    want = n.select("scenario", F.col("id").alias("expected_id"), F.lit(10).alias("most_rank"), F.create_map(F.lit("age"), F.lit("match"), F.lit("region"), F.lit("match")).alias("expected"))
    got = n.where("scenario % 4 <> 0").select("scenario", "id", "rank", F.create_map(F.lit("age"), F.when(F.col("scenario") % 4 == 2, "unknown").otherwise("match"), F.lit("region"), F.lit("match")).alias("verdicts"))
    return evidence.acceptance(got, want)


@_query("""SELECT l_orderkey * 10 + l_linenumber AS key, concat_ws(',', CASE WHEN l_discount > 0.08 THEN 'discount' END, CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'flags' END) AS failed FROM lineitem WHERE l_discount > 0.08 OR (l_returnflag = 'R' AND l_linestatus = 'O')""")
def inventory_checks(spark, d):
    rows = table(spark, d, "lineitem").withColumn("k", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return evidence.cross_checks(rows, {"discount": F.col("l_discount") <= 0.08, "flags": ~((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"))}, "k")


@_query("""WITH r AS (SELECT o_custkey AS k, o_orderstatus AS s FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) SELECT count(*) FILTER (WHERE s IS NULL OR s = 'O') AS waiting, bool_and(coalesce(s = 'F', false)) AS ready FROM customer LEFT JOIN r ON k = c_custkey""")
def promotion_wait(spark, d):
    runs = audit.first_of_each(table(spark, d, "orders"), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()])
    s = F.col("o_orderstatus")
    state = runs.select(F.col("o_custkey").alias("source"), F.when(s == "O", "running").when(s == "F", "succeeded").otherwise("failed").alias("status"))
    return evidence.ready(state, table(spark, d, "customer").select(F.col("c_custkey").alias("source")))


@_query("""SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'age:19|income:' || c_name || '~low' WHEN 1 THEN 'income:low' ELSE '' END AS parts FROM customer""")
def eligibility_parts(spark, d):
    k = (F.col("c_custkey") % 3).cast("int")
    row = F.create_map(F.lit("ageText"), F.when(k == 0, " 19 "), F.lit("income1"), F.when(k == 0, F.col("c_name")).otherwise(" "), F.lit("income2"), F.when(k < 2, "low"))
    parts = evidence.eligibility({"age": ("ageText",), "income": ("income1", "income2")}, row)
    said = F.transform(parts, lambda x: F.concat(x["kind"], F.lit(":"), F.replace(x["text"], F.lit("\n"), F.lit("~"))))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.array_join(said, "|").alias("parts"))


@_query("""WITH e AS (SELECT l_orderkey % 997 AS id, l_returnflag AS g FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 3 = 0), t AS (SELECT g, count(*) - CASE WHEN g = 'R' THEN 1 ELSE 0 END AS n FROM e GROUP BY g)
SELECT CAST(id AS VARCHAR) AS key, 'repeated' AS blocker FROM e GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'total', 'fewer_reported' FROM (SELECT (SELECT sum(n) FROM t) AS n, (SELECT count(*) FROM e) AS m) WHERE m > n""")
def list_groups(spark, d):
    """First lines of orders as lists of three groups that report their totals, one of them too few."""
    e = table(spark, d, "lineitem").where("l_linenumber = 1 AND l_orderkey % 3 = 0").select((F.col("l_orderkey") % 997).alias("id"), F.col("l_returnflag").alias("g"))
    totals = e.groupBy("g").agg((F.count(F.lit(1)) - F.when(F.first("g") == "R", 1).otherwise(0)).alias("n"))
    _, faults = evidence.both_groups([e.where(F.col("g") == x).select("id") for x in ("A", "N", "R")], totals)
    return faults


@_query("""WITH p AS (SELECT page_id AS k, page_id % 4 AS scheme, page_id // 2 % 3 AS port, page_id // 3 % 3 AS path, page_id // 5 % 4 AS q, page_id // 7 % 2 AS who, split_part(url, '/', 3) AS host FROM pages),
u AS (SELECT *, 'https://' || lower(host) AS head, CASE port WHEN 1 THEN ':8443' WHEN 2 THEN ':80' ELSE '' END AS at_port, CASE path WHEN 0 THEN '/' WHEN 1 THEN '/P/x/' ELSE '/a%20b' END || CASE q WHEN 1 THEN '?a=1&b=' || k WHEN 2 THEN '?utm_x=1&z' WHEN 3 THEN '' ELSE '' END AS tail FROM p)
SELECT k AS page_id, CASE WHEN scheme < 3 THEN head || tail END AS loose, CASE WHEN scheme < 2 THEN head || at_port || tail END AS strict FROM u""")
def comparison_urls(spark, d):
    """Addresses of pages with schemes, ports, paths, parameters, fragments and names put together in all ways."""
    k = F.col("page_id")
    at = lambda n, m: F.floor(k / n) % m
    pick = lambda key, *vs: F.element_at(F.array(*[v if isinstance(v, Column) else F.lit(v) for v in vs]), (key + 1).cast("int"))
    host = F.element_at(F.split("url", "/"), 3)
    query = pick(at(5, 4), "", F.concat(F.lit("?b="), k.cast("string"), F.lit("&&a=1#f")), "?z&utm_x=1", "?#only")
    made = F.concat(pick(k % 4, "https://", " HTTPS://", "http://", "ftp://"), pick(at(7, 2), "", "user:pw@"), F.when(k % 2 == 0, F.upper(host)).otherwise(host), pick(at(2, 3), "", ":8443", ":80"), pick(at(3, 3), "", "/P/x/", "/a%20b"), query)
    return table(spark, d, "pages").select("page_id", text.comparison_url(made).alias("loose"), text.comparison_url(made, https_only=True, keep_port=True).alias("strict"))

@_query("""WITH p AS (SELECT p_partkey AS k, p_name AS t, p_brand AS b, p_partkey % 5 AS n, n_name FROM part JOIN nation ON n_nationkey = p_partkey % 5),
a AS (SELECT *, CASE WHEN k % 19 = 0 THEN 'exclude_invalid/invalid_identity_url_or_provenance' WHEN k % 23 = 0 THEN 'exclude_failed/checkpoint_failed' WHEN k % 29 = 0 OR k % 31 = 0 THEN 'exclude_closed/application_closed' WHEN k % 41 = 0 THEN 'hold_review/youth_target_unconfirmed'
  WHEN k % 43 = 0 THEN 'hold_review/regional_evidence_not_admissible' WHEN k % 37 = 0 THEN 'hold_review/current_application_unconfirmed' END AS first, k % 13 = 0 AS bad FROM p),
w AS (SELECT *, min(k) FILTER (WHERE first IS NULL AND NOT bad) OVER (PARTITION BY t, b, n) AS head FROM a),
r AS (SELECT k, CASE WHEN first IS NOT NULL THEN first || '/1' WHEN bad THEN 'exclude_invalid/normalized_program_invalid/2' WHEN head < k OR (starts_with(t, 'red') AND k % 7 = 0) THEN 'exclude_duplicate/duplicate_confirmed/3' WHEN starts_with(t, 'small') THEN 'hold_review/duplicate_review_required/3'
  ELSE 'promote_partial/all_admission_conditions_satisfied/3' END AS x FROM w)
SELECT k AS id, split_part(x, '/', 1) AS outcome, split_part(x, '/', 2) AS reason, CAST(split_part(x, '/', 3) AS INT) AS round FROM r""")
def review_pipeline(spark, d):
    """Review candidates to their end: classified, normalised, compared with each other and a baseline, and classified again."""
    k = F.col("p_partkey")
    rows = table(spark, d, "part").join(table(spark, d, "nation"), F.col("n_nationkey") == k % 5)
    none = F.array().cast("array<string>")
    good = [F.when(k % 43 != 0, "source_region_confirmed"), F.when(k % 37 != 0, "application_period_open")]
    candidates = rows.select(k.alias("id"), (k % 19 != 0).alias("identity_valid"), F.when(k % 23 == 0, "failed").when(k % 29 == 0, "closed").otherwise("review").alias("checkpoint"), F.when(k % 31 == 0, "closed").otherwise("open").alias("application"), F.when(k % 41 == 0, none).otherwise(F.array(F.lit("청년"))).alias("markers"), F.array_compact(F.array(*good)).alias("original"), none.alias("current"))
    extracted = rows.select(k.alias("id"), F.lit("s").alias("source_id"), F.when(k % 13 != 0, k.cast("string")).alias("external_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("organization"), F.lit("주거").alias("category_text"), F.lit("상시").alias("application_period_text"), F.col("n_name").alias("region_text"), F.lit("만 19세 ~ 34세").alias("age_condition_text"), F.lit("Help").alias("support_content"), F.concat(F.lit("https://a.kr/"), k).alias("source_url"), F.lit("1996-06-15").cast("timestamp").alias("collected_at"))
    names = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.concat(F.lit("n"), "n_nationkey").alias("code"), F.col("n_name").alias("full_name"))
    day = F.lit(None).cast("date")
    own = lambda title, url: [F.concat(F.lit("b"), k).alias("id"), title.alias("title_key"), F.lit("other").alias("org_key"), F.lit("other").alias("support_key"), F.array(F.lit("x")).alias("region_keys"), day.alias("application_start"), day.alias("application_end"), F.when(url, F.array(F.concat(F.lit("https://a.kr/"), k))).otherwise(none).alias("urls"), none.alias("announcements")]
    small = rows.where("p_name LIKE 'small%'").dropDuplicates(["p_name"]).select(*own(F.replace("p_name", F.lit(" "), F.lit("")), F.lit(False)))
    red = rows.where("p_name LIKE 'red%' AND p_partkey % 7 = 0").select(*own(F.concat(F.lit("nothing like it "), k), F.lit(True)))
    return evidence.reviewed(candidates, extracted, names, small.unionByName(red)).select("id", "outcome", "reason", "round")
