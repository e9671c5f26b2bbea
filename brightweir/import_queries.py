"""Registered queries of whole programs, imports, baselines and what pages show, over real columns, with their rules as SQL."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brightweir.catalog_queries import _query
from brightweir.functions import wording
from brightweir.operators import display, ingest, program, snapshot, validate
from brightweir.policy_queries import _P, TODAY, policies
from brightweir.session import scratch, table
from brightweir.sources import raw

_SAID = {0: "주거", 1: "금융,창업", 2: "일자리, 교육", 3: "mystery,기타", 4: ""}


@_query("""WITH p AS (SELECT *, p_partkey % 5 AS c, p_partkey % 6 AS w, p_size % 4 AS a, p_partkey % 8 AS g, DATE '1996-01-01' + CAST(p_partkey % 330 AS INT) AS s, p_partkey % 2 AS src,
  CASE WHEN p_partkey % 3 = 0 THEN DATE '1996-06-14' ELSE DATE '1996-06-15' END AS today, n_name, n_nationkey FROM part LEFT JOIN nation ON n_nationkey = p_partkey % 25),
q AS (SELECT *, s + 40 AS e, CASE a WHEN 0 THEN p_size WHEN 1 THEN NULL WHEN 2 THEN CASE WHEN src = 0 THEN NULL ELSE 0 END ELSE NULL END AS low, CASE a WHEN 0 THEN p_size + 20 WHEN 1 THEN p_size WHEN 2 THEN CASE WHEN src = 0 THEN NULL ELSE 0 END ELSE NULL END AS high FROM p),
v AS (SELECT *, CASE c WHEN 0 THEN ['housing'] WHEN 1 THEN ['finance', 'startup'] WHEN 2 THEN ['employment', 'education'] WHEN 3 THEN ['other'] ELSE [] END AS cats, CASE WHEN g = 0 THEN 'nationwide' WHEN g < 5 THEN 'regional' ELSE 'unknown' END AS scope,
  CASE WHEN g = 0 THEN ['전국'] WHEN g < 4 THEN [n_name] WHEN g = 4 THEN [n_name, 'FIXED'] ELSE [] END AS regs, CASE w WHEN 0 THEN s WHEN 1 THEN s END AS start_day, CASE w WHEN 0 THEN e END AS end_day, CASE w WHEN 0 THEN 'fixed_period' WHEN 1 THEN 'fixed_period' WHEN 2 THEN 'always' END AS schedule,
  CASE w WHEN 0 THEN CASE WHEN today < s THEN 'scheduled' WHEN today > e THEN 'closed' ELSE 'open' END WHEN 1 THEN CASE WHEN today < s THEN 'scheduled' END WHEN 2 THEN 'open' WHEN 3 THEN 'closed' END AS status,
  list_filter([CASE WHEN c = 3 THEN '$.category_text|unmapped_category|warning' END, CASE WHEN w = 4 THEN '$.application_period_text|unparsed_application_period|warning' END, CASE WHEN a = 2 AND src = 0 THEN '$.age_condition_text|placeholder_age_range|warning' END, CASE WHEN g IN (5, 6) THEN '$.region_text|unmapped_region_code|warning' END], lambda x: x IS NOT NULL) AS noted,
  list_filter([CASE WHEN c = 4 THEN '$.categories|missing_categories|warning' END, CASE WHEN g > 4 THEN '$.regions|missing_regions|warning' END, CASE WHEN a = 3 THEN '$.age_condition_text|missing_age_condition|warning' END, CASE WHEN a = 2 AND src = 0 THEN '$.age_condition_text|unstructured_age_condition|warning' END,
    CASE WHEN w = 5 THEN '$.application_period_text|missing_application_period|warning' END], lambda x: x IS NOT NULL) AS gaps FROM q)
SELECT p_partkey AS id, '1.2.0' AS schema_version, 'src' || src AS source_id, p_name || ' & more' AS title, CASE WHEN p_partkey % 9 <> 0 THEN p_type END AS summary, array_to_string(cats, ',') AS categories, p_brand AS keywords, start_day AS application_start, end_day AS application_end, schedule AS application_schedule, status AS application_status,
  array_to_string(regs, ',') AS regions, scope AS coverage_scope, CASE WHEN g = 0 THEN '' WHEN g < 4 THEN 'include/matched/n' || n_nationkey WHEN g = 4 THEN 'include/matched/n' || n_nationkey || ',include/matched/x1' WHEN g < 7 THEN 'include/unmapped/Atlantis' ELSE '' END AS region_rules, CAST(low AS INT) AS age_min, CAST(high AS INT) AS age_max,
  CASE WHEN p_partkey % 13 = 0 THEN 'invalid' WHEN len(noted) + len(gaps) > 0 THEN 'partial' ELSE 'valid' END AS data_quality_status, array_to_string(CASE WHEN p_partkey % 13 = 0 THEN list_concat(['$.external_id|required|error'], noted) ELSE list_concat(noted, gaps) END, ',') AS issues, CAST(37 AS INT) AS n_fields FROM v""")
def normalized_rows(spark, d):
    """Programs written out as an extractor finds them, normalised to whole rows of the contract."""
    k, size = F.col("p_partkey"), F.col("p_size")
    day = F.date_add(F.lit("1996-01-01").cast("date"), (k % 330).cast("int"))
    dot = lambda c: F.date_format(c, "yyyy.MM.dd")
    by = lambda key, values: functools.reduce(lambda w, kv: w.when(key == kv[0], kv[1]), list(values.items())[1:], F.when(key == next(iter(values)), next(iter(values.values()))))
    period = by(k % 6, {0: F.concat_ws(" ~ ", dot(day), dot(F.date_add(day, 40))), 1: F.concat(dot(day), F.lit("<br>부터")), 2: F.lit("상시"), 3: F.lit("<b>마감</b>"), 4: F.lit("later")})
    age = by(size % 4, {0: F.concat(F.lit("만 "), size, F.lit("세 ~ "), size + 20, F.lit("세")), 1: F.concat(size, F.lit("세 이하")), 2: F.lit("0세 ~ 0세")})
    nation = F.col("n_name")
    region = by(k % 8, {0: F.lit("전국"), 1: nation, 2: nation, 3: F.concat_ws(",", nation, nation), 4: F.concat_ws(" | ", nation, F.lit("Fix")), 5: F.lit("Atlantis"), 6: F.lit("Atlantis")})
    rows = table(spark, d, "part").join(table(spark, d, "nation"), F.col("n_nationkey") == k % 25, "left").select(
        k.alias("id"), F.concat(F.lit("src"), k % 2).alias("source_id"), F.when(k % 13 != 0, k.cast("string")).alias("external_id"), F.concat(F.lit("<p>"), "p_name", F.lit("</p> &amp; more")).alias("title"), F.when(k % 9 != 0, F.col("p_type")).alias("summary"),
        by(k % 5, {i: F.lit(v) for i, v in _SAID.items()}).alias("category_text"), F.array(F.concat(F.lit(" "), "p_brand"), F.lit(" "), F.col("p_brand")).alias("keywords"), period.alias("application_period_text"), region.alias("region_text"), age.alias("age_condition_text"),
        # The day in Korea is the next one for two of three.
        F.when(k % 3 == 0, F.lit("1996-06-14 14:30:00")).otherwise("1996-06-14 15:30:00").cast("timestamp").alias("collected_at"),
    )
    n = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.concat(F.lit("n"), "n_nationkey").alias("code"), F.col("n_name").alias("full_name"))
    names = n.unionByName(spark.createDataFrame([("Fix", "x1", "FIXED")], "name string, code string, full_name string"))
    out = program.normalized(rows, names, blank_zero_ages=("src0",))
    text = lambda c: F.array_join(c, ",").alias(c)
    return out.select("id", "schema_version", "source_id", "title", "summary", text("categories"), text("keywords"), "application_start", "application_end", "application_schedule", "application_status", text("regions"), "coverage_scope", text("region_rules"), "age_min", "age_max", "data_quality_status", text("issues"), F.lit(len(out.columns) - 2).alias("n_fields"))


@_query(f"""WITH {_P}, r AS (SELECT id, CASE WHEN id % 31 = 0 THEN '0.9' WHEN id % 2 = 0 THEN '1.1.0' ELSE '1.2.0' END AS v, title, regs, cats, age_min, age_max, age_text, period_text, schedule, status, application_start, application_end, scope FROM p)
SELECT id, concat_ws(',', CASE WHEN v = '0.9' THEN 'unsupported_schema_version' END, CASE WHEN age_min > age_max OR application_start > application_end THEN 'invalid' END, CASE WHEN id % 17 = 0 THEN 'mail' END) AS faults,
  CASE WHEN v <> '0.9' AND NOT coalesce(age_min > age_max, false) AND NOT coalesce(application_start > application_end, false) AND id % 17 <> 0 THEN '1.2.0/' || title || '/' || CASE WHEN cats = '' OR regs = '' OR age_text IS NULL OR (age_min IS NULL AND age_max IS NULL AND NOT contains(age_text, '제한 없음')) OR (period_text IS NULL AND application_start IS NULL AND application_end IS NULL AND schedule IS NULL AND status IS NULL)
    OR (schedule = 'fixed_period' AND application_start IS NULL AND application_end IS NULL) THEN 'partial' ELSE 'valid' END || '/' || CASE WHEN id % 3 = 0 THEN '[{{"relation":"include","code":"n1"}},{{"relation":"exclude","code":"n2"}}]' ELSE '[]' END END AS record FROM r""")
def public_records(spark, d):
    """Rows of the policy table as public records, with their rules, versions and checks."""
    k = F.col("id")
    p = policies(spark, d)
    rows = p.withColumns({"schema_version": F.when(k % 31 == 0, "0.9").when(k % 2 == 0, "1.1.0").otherwise("1.2.0"), "application_period_text": F.col("period_text"), "application_schedule": F.col("schedule"), "application_status": F.col("status"), "coverage_scope": F.col("scope"), "age_condition_text": F.col("age_text"), "data_quality_status": F.lit("valid")})
    rules = p.where(k % 3 == 0).select(k.alias("policy"), F.explode(F.expr("array(named_struct('pos', 2, 'relation', 'exclude', 'code', 'n2'), named_struct('pos', 1, 'relation', 'include', 'code', 'n1'))")).alias("x")).select("policy", "x.*")
    out = program.public_records(rows, rules, {"mail": k % 17 != 0})
    at = lambda key: F.get_json_object("record", f"$.{key}")
    return out.select("id", F.array_join("faults", ",").alias("faults"), F.when(F.col("record").isNotNull(), F.concat_ws("/", at("schema_version"), at("title"), at("data_quality_status"), at("region_rules"))).alias("record"))


@_query("""WITH b AS (SELECT DISTINCT user_id % 7 AS s, event_id FROM events WHERE event_type = 'purchase') SELECT event_id AS document_id, event_type AS role FROM events e WHERE EXISTS (SELECT 1 FROM b WHERE b.s = e.user_id % 7 AND b.event_id % 90 = e.event_id % 90)""")
def chosen_batches(spark, d):
    """Documents of the identities that a checkpoint has."""
    e = table(spark, d, "events").select(F.col("event_id").alias("document_id"), F.col("event_type").alias("role"), (F.col("user_id") % 7).alias("source_id"), (F.col("event_id") % 90).alias("external_id"))
    return ingest.chosen_batch(e, e.where("role = 'purchase'").select("source_id", "external_id")).select("document_id", "role")


@_query("""SELECT coalesce(a.k, b.k) AS k, total, lines, a.k IS NOT NULL AND b.k IS NOT NULL AS aligned FROM (SELECT o_orderkey AS k, o_totalprice > 100000 AS total FROM orders WHERE o_orderstatus <> 'P') a
FULL JOIN (SELECT l_orderkey AS k, count(*) AS lines FROM lineitem WHERE l_quantity > 25 GROUP BY 1) b ON a.k = b.k""")
def aligned_rows(spark, d):
    """Orders beside the sums of their lines; positions of one side alone are told."""
    a = table(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") > 100000).alias("total"))
    b = table(spark, d, "lineitem").where("l_quantity > 25").groupBy(F.col("l_orderkey").alias("k")).agg(F.count(F.lit(1)).alias("lines"))
    return ingest.aligned(a, b, "k")


@_query(f"""WITH {_P} SELECT id, CASE WHEN id % 10 = 3 THEN NULL ELSE application_start END AS application_start, application_end, TIMESTAMP '1996-06-15 00:00:00' AS created_at, TIMESTAMP '1996-06-15 00:00:00' AS updated_at, true AS live FROM p""")
def policy_write_rows(spark, d):
    """Programs with days as texts, some of them no days, as the table holds them; what the public doesn't see is left out."""
    p = policies(spark, d)
    rows = p.select("id", F.when(F.col("id") % 10 == 3, F.concat(F.col("application_start").cast("string"), F.lit("x"))).otherwise(F.col("application_start").cast("string")).alias("application_start"), F.col("application_end").cast("string").alias("application_end"), "quality", "collected_at")
    out = ingest.read_columns(ingest.write_row(rows, F.lit(TODAY).cast("timestamp")), ("quality", "collected_at"))
    return out.withColumn("live", F.col("inactive_at").isNull()).drop("inactive_at").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("created_at", "updated_at")})


@_query(f"""WITH {_P}, own AS (SELECT * FROM p WHERE source_id IN ('src0', 'src1', 'src2') AND quality <> 'invalid' AND coalesce(status <> 'closed', true)), s AS (SELECT 'src0' AS source_id, DATE '1996-06-09' AS done UNION ALL SELECT 'src1', DATE '1996-05-20')
SELECT source_id AS key, CAST(id AS BIGINT) AS id, NULL AS blocker FROM own UNION ALL
SELECT k.source_id, NULL, CASE WHEN n = 0 THEN 'no_rows' WHEN done IS NULL THEN 'no_snapshot' ELSE 'newer_than_snapshot' END FROM (SELECT x.source_id, any_value(s.done) AS done, count(own.id) AS n, max(collected_at) AS newest FROM (VALUES ('src0'), ('src1'), ('src2'), ('src9')) AS x(source_id) LEFT JOIN own ON own.source_id = x.source_id LEFT JOIN s ON s.source_id = x.source_id GROUP BY 1) k
WHERE n = 0 OR done IS NULL OR newest > done""".replace("('src0', 'src1', 'src2')", "('src0', 'src1', 'src2', 'src9')"))
def aggregator_baseline(spark, d):
    """Active rows of approved sources, and what is wrong with their snapshots."""
    shots = spark.createDataFrame([("src0", "1996-06-09"), ("src1", "1996-05-20")], "source_id string, t string").select("source_id", F.col("t").cast("date").alias("completed_at"))
    rows, faults = ingest.baseline(policies(spark, d), shots, ("src0", "src1", "src2", "src9"), F.coalesce(F.col("status") != "closed", F.lit(True)))
    return rows.select(F.col("source_id").alias("key"), F.col("id").cast("long").alias("id"), F.lit(None).cast("string").alias("blocker")).unionByName(faults.select(F.col("source_id").alias("key"), F.lit(None).cast("long").alias("id"), "blocker"))


@_query("""WITH a AS (SELECT o_custkey AS k, list((o_orderkey, o_orderstatus) ORDER BY o_orderkey) AS x FROM orders GROUP BY 1), b AS (SELECT o_custkey AS k, list((o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN 'new' ELSE o_orderstatus END) ORDER BY o_orderkey) AS y FROM orders WHERE o_orderkey % 211 <> 0 GROUP BY 1)
SELECT coalesce(a.k, b.k) AS profile FROM a FULL JOIN b ON a.k = b.k WHERE x IS DISTINCT FROM y""")
def replayed_actions(spark, d):
    """Profiles whose actions, done again, are others."""
    o = table(spark, d, "orders")
    a = o.select(F.col("o_custkey").alias("profile"), F.col("o_orderkey").alias("position"), F.col("o_orderstatus").alias("kind"), F.lit("x").alias("target"))
    b = a.where("position % 211 <> 0").withColumn("kind", F.when(F.col("position") % 97 == 0, "new").otherwise(F.col("kind")))
    return ingest.same_actions(a, b, "profile")


@_query("""WITH r AS (SELECT 'n' || n_nationkey AS code, r_name || ' ' || n_name AS full_name, n_name AS name, lpad(CAST(n_regionkey AS VARCHAR), 2, '1') || CASE WHEN n_nationkey < 5 THEN repeat('0', 8) ELSE lpad(CAST(n_nationkey AS VARCHAR), 3, '0') || '00000' END AS digits FROM nation JOIN region ON r_regionkey = n_regionkey)
SELECT alias, code, CASE WHEN digits = repeat('0', 10) THEN 'country' WHEN digits LIKE '%00000000' THEN 'province' ELSE 'district' END AS level FROM (SELECT full_name AS alias, code, digits FROM r UNION SELECT name, code, digits FROM r UNION SELECT substr(name, 1, 3), code, digits FROM r WHERE substr(code, 2)::INT % 2 = 0) AS u""")
def region_aliases(spark, d):
    """Full, short and curated names of regions, each once, and the level that a code stands for."""
    k = F.col("n_nationkey")
    digits = F.concat(F.lpad(F.col("n_regionkey").cast("string"), 2, "1"), F.when(k < 5, "0" * 8).otherwise(F.concat(F.lpad(k.cast("string"), 3, "0"), F.lit("00000"))))
    r = table(spark, d, "nation").join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey")).select(F.concat(F.lit("n"), k).alias("code"), F.concat_ws(" ", "r_name", "n_name").alias("full_name"), F.col("n_name").alias("name"), digits.alias("digits"), k.alias("k"))
    curated = r.where("k % 2 = 0").select(F.substring("name", 1, 3).alias("alias"), "code")
    return ingest.aliases(r, curated).join(r.select("code", wording.region_level(F.col("digits")).alias("level")), "code").select("alias", "code", "level")


@_query(f"""WITH {_P}, c AS (SELECT coalesce(schedule = 'fixed_period', false) AS cohort, coalesce(CASE WHEN application_start IS NULL AND application_end IS NULL THEN status IS NULL WHEN application_start > application_end THEN false WHEN application_start > DATE '1996-06-15' THEN status = 'scheduled' WHEN application_end < DATE '1996-06-15' THEN status = 'closed' ELSE status = 'open' END, false) AS ok FROM p)
SELECT count(*) FILTER (WHERE cohort) AS cohort, count(*) FILTER (WHERE cohort AND ok) AS consistent, count(*) FILTER (WHERE cohort AND NOT ok) AS inconsistent, count(*) FILTER (WHERE cohort AND NOT ok) = 0 AS passed FROM c""")
def period_safety(spark, d):
    """How many programs of a cohort have a status that fits their period."""
    s, e, have, today = F.col("application_start"), F.col("application_end"), F.col("status"), F.lit(TODAY).cast("date")
    fits = F.when(s.isNull() & e.isNull(), have.isNull()).when(s > e, False).when(s > today, have == "scheduled").when(e < today, have == "closed").otherwise(have == "open")
    return ingest.safety_report(policies(spark, d), F.coalesce(fits, F.lit(False)), F.coalesce(F.col("schedule") == "fixed_period", F.lit(False)))


@_query(f"""WITH {_P} SELECT count(*) FILTER (WHERE cats = '' OR age_text IS NULL) AS unknown_items, count(*) FILTER (WHERE scope = 'unknown') AS unconfirmed_regions FROM p""")
def unknown_items(spark, d):
    """How many items of a response have an open condition, and how many no confirmed region."""
    open_ = F.array_compact(F.array(F.when(F.col("cats") == "", "category"), F.when(F.col("age_text").isNull(), "age")))
    reasons = F.array_compact(F.array(F.lit("TEXT"), F.when(F.col("scope") == "unknown", "REGION_UNCONFIRMED")))
    return ingest.unknown_counts(policies(spark, d).select(open_.alias("unknown_conditions"), reasons.alias("reasons")))


@_query("""SELECT c_custkey, CASE WHEN n IS NULL THEN 'absent' WHEN c_acctbal < 0 OR c_mktsegment = 'BUILDING' THEN 'updated' ELSE 'unchanged' END AS outcome FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def reactivations(spark, d):
    """Outcomes of an import in which rows come back (here: of a negative balance) or change."""
    seen = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("seen", F.lit(True))
    c = table(spark, d, "customer").join(seen, "c_custkey", "left")
    return c.select("c_custkey", snapshot.reactivated(F.col("c_acctbal") < 0, F.coalesce("seen", F.lit(False)), F.col("c_mktsegment") == "BUILDING").alias("outcome"))


@_query(f"""WITH {_P} SELECT quality AS class, count(*) AS n, min(id) AS first_id FROM p GROUP BY quality""")
def quality_partitions(spark, d):
    parts = validate.partitions(policies(spark, d).withColumn("class", F.col("quality")))
    each = [df.agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).select(F.lit(c).alias("class"), "n", "first_id") for c, df in parts.items()]
    return functools.reduce(DataFrame.unionByName, each).where("n > 0")


_CLIENT = {"title_asc": "rank", "title_desc": "rank DESC", "deadline_asc": "application_end NULLS LAST", "deadline_desc": "application_end DESC NULLS LAST", "collected_desc": "collected_at DESC", "collected_asc": "collected_at"}
_LETTERS = ("apple", "Banana", "cherry", "가나", "나무", "다리", "마을")


@_query(f"WITH {_P}, t AS (SELECT *, id % {len(_LETTERS)} AS rank FROM p) " + " UNION ALL ".join(f"SELECT '{s}' AS sort, id, row_number() OVER (ORDER BY {k}, id) AS rank FROM t" for s, k in _CLIENT.items()))
def client_sorts(spark, d):
    """The browser's orders over titles of Korean and other words; the SQL side knows the words' order by number."""
    title = F.element_at(F.array(*map(F.lit, ("가나", "나무", "다리", "마을", "apple", "Banana", "cherry"))), (F.col("id") % len(_LETTERS) + 1).cast("int"))
    rows, out = policies(spark, d).withColumn("title", title), None
    for s in _CLIENT:
        place = F.row_number().over(Window.orderBy(*display.client_order(s))).cast("long")
        one = rows.select(F.lit(s).alias("sort"), "id", place.alias("rank"))
        out = one if out is None else out.unionByName(one)
    return out


@_query("""WITH g AS (SELECT n_name AS label, r_name AS province, r_name || ' ' || n_name AS value FROM nation JOIN region ON r_regionkey = n_regionkey),
a AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN ' ' || r_name || ' ' WHEN 1 THEN r_name || ' ' || n_name WHEN 2 THEN n_name END AS region FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)
SELECT s_suppkey, coalesce(p.province, g.province, '') AS province, coalesce(g.value, '') AS district, coalesce(k.n, 0) AS districts FROM a LEFT JOIN (SELECT DISTINCT province FROM g) p ON p.province = trim(region) LEFT JOIN g ON g.value = trim(region) LEFT JOIN (SELECT province, count(*) AS n FROM g GROUP BY 1) k ON k.province = coalesce(p.province, g.province)""")
def split_regions(spark, d):
    """Provinces with their districts, and addresses split into both."""
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    tree = spark.createDataFrame([("world", None, "World")], "code string, parent string, name string")
    tree = tree.unionByName(r.select(F.concat(F.lit("r"), "r_regionkey").alias("code"), F.lit("world").alias("parent"), F.col("r_name").alias("name"))).unionByName(n.select(F.concat(F.lit("n"), "n_nationkey").alias("code"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_name").alias("name")))
    k = F.col("s_suppkey") % 4
    said = F.when(k == 0, F.concat(F.lit(" "), "r_name", F.lit(" "))).when(k == 1, F.concat_ws(" ", "r_name", "n_name")).when(k == 2, F.col("n_name"))
    asked = table(spark, d, "supplier").join(n, F.col("n_nationkey") == F.col("s_nationkey")).join(r, F.col("r_regionkey") == F.col("n_regionkey")).select("s_suppkey", said.alias("region"))
    groups = display.region_groups(tree)
    out = display.split_regions(asked, groups).join(groups, "province", "left")
    return out.select("s_suppkey", "province", "district", F.coalesce(F.size("districts"), F.lit(0)).cast("long").alias("districts"))


@_query("""SELECT n_nationkey AS k, CASE WHEN n_nationkey % 7 = 6 THEN 'seed_root_not_array' WHEN n_nationkey % 7 = 5 THEN 'seed_not_json' END AS fault, CASE WHEN n_nationkey % 7 < 5 THEN count(c_custkey) ELSE 0 END AS items, CASE WHEN n_nationkey % 7 < 5 THEN coalesce(sum(c_custkey), 0) ELSE 0 END AS total FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey""")
def seed_arrays(spark, d):
    """A seed file a nation, an array of its customers; some are objects or broken."""
    at = scratch(spark, "seeds")
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.to_json(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name")))).alias("j"))
    k = F.col("k")
    text = F.coalesce("j", F.lit("[]"))
    files = table(spark, d, "nation").select(F.col("n_nationkey").alias("k")).join(c, "k", "left").select(k, F.when(k % 7 == 6, F.concat(F.lit('{"rows":'), text, F.lit("}"))).when(k % 7 == 5, F.concat(F.lit("["), text)).otherwise(text).alias("value"))
    files.select("value", k.alias("n")).repartition("n").write.partitionBy("n").text(at)
    rows, faults = raw.json_array(spark, f"{at}/n=*", "struct<c_custkey: bigint, c_name: string>")
    name = lambda: F.regexp_extract(F.col("path"), r"n=(\d+)/", 1).cast("long")
    paths = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(at).select(name().alias("k"), "path")
    per = rows.groupBy("file").agg(F.count(F.lit(1)).alias("items"), F.sum("item.c_custkey").alias("total"))
    return paths.join(per, F.col("path") == F.col("file"), "left").drop("file").join(faults.withColumnRenamed("file", "path"), "path", "left").select("k", "fault", F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("total", F.lit(0)).alias("total"))
