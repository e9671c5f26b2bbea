"""Registered queries of the catalog operators and their SQL, over the whole driver tables."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightweir.functions import parsing, periods, text
from brightweir.operators import audit, integrity, release, search, snapshot, verdict
from brightweir.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


AS_OF = "1996-06-15"
TERMS = ["the", "support", "und", "de"]


@_query(f"""SELECT o_orderkey, o_orderstatus, CAST(o_orderdate AS DATE) AS due,
  row_number() OVER (ORDER BY CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_orderdate AS DATE) END NULLS LAST, o_orderkey) AS rank
FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '{AS_OF}' AND o_orderstatus <> 'F'
QUALIFY rank BETWEEN 21 AND 70""")
def list_filter_sort_page(spark, d):
    """Visibility filter, sort with nulls last and id as tie-break, one page (a top-k report)."""
    due = periods.day(F.col("o_orderdate"))
    rows = table(spark, d, "orders").where((due >= F.lit(AS_OF).cast("date")) & (F.col("o_orderstatus") != "F")).select("o_orderkey", "o_orderstatus", due.alias("due"))
    key = F.when(F.col("o_orderstatus") != "P", F.col("due"))
    return search.ranked(rows, [key.asc_nulls_last(), F.col("o_orderkey")], top=50, offset=20)


@_query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def membership_semi(spark, d):
    members = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(members, "c_custkey", "left_semi").select("c_custkey", "c_name")


@_query("""SELECT 'customer' AS kind, c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
UNION ALL SELECT 'part', p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey)""")
def orphan_anti(spark, d):
    customers = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti")
    parts = table(spark, d, "part").join(table(spark, d, "lineitem"), F.col("l_partkey") == F.col("p_partkey"), "left_anti")
    return customers.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id")).unionByName(parts.select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id")))


@_query("""SELECT r_name, n_name, count(*) AS n, sum(c_acctbal) > 0 AS positive FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL""")
def alias_join(spark, d):
    names = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    per = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), (F.sum("c_acctbal") > 0).alias("positive"))
    return per.join(names, F.col("c_nationkey") == F.col("n_nationkey")).select("r_name", "n_name", "n", "positive")


def _tree(spark, d):
    """world > region > nation as codes with their parents."""
    world = spark.createDataFrame([("world", None)], "code string, parent string")
    regions = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("code"), F.lit("world").alias("parent"))
    nations = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("code"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    return world.unionByName(regions).unionByName(nations)


_TREE = """nodes AS (SELECT 'world' AS code, CAST(NULL AS VARCHAR) AS parent UNION ALL SELECT 'r' || r_regionkey, 'world' FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
closure AS (SELECT code, code AS ancestor, 0 AS distance FROM nodes
  UNION ALL SELECT c.code, n.parent, c.distance + 1 FROM closure c JOIN nodes n ON n.code = c.ancestor WHERE n.parent IS NOT NULL)"""


@_query(f"WITH RECURSIVE {_TREE} SELECT code, ancestor, distance FROM closure")
def region_closure(spark, d):
    return verdict.closure(_tree(spark, d))


@_query(f"""WITH RECURSIVE {_TREE},
policies AS (SELECT c_custkey AS policy, CASE WHEN c_custkey % 11 = 0 THEN 'nationwide' WHEN c_custkey % 7 = 0 THEN NULL ELSE 'regional' END AS scope, c_nationkey FROM customer),
rules AS (SELECT policy, CASE WHEN policy % 5 = 0 THEN 'exclude' ELSE 'include' END AS relation, 'n' || c_nationkey AS code, policy % 17 <> 0 AS good, policy % 2 = 0 AS near_by FROM policies WHERE policy % 13 <> 0
  UNION ALL SELECT policy, 'include', 'r' || (c_nationkey % 5), policy % 19 <> 0, true FROM policies WHERE policy % 3 = 0),
per AS (SELECT policy, count(*) FILTER (WHERE good AND relation = 'exclude' AND p.distance IS NOT NULL) AS shut, min(p.distance) FILTER (WHERE good AND relation = 'include') AS near,
  min(b.distance) FILTER (WHERE good AND relation = 'include') AS deep, count(*) FILTER (WHERE good AND relation = 'include') AS includes, count(*) FILTER (WHERE NOT good AND near_by) AS lost
  FROM rules LEFT JOIN (SELECT ancestor, distance FROM closure WHERE code = 'r2') p ON p.ancestor = rules.code
  LEFT JOIN (SELECT code, distance FROM closure WHERE ancestor = 'r2' AND distance > 0) b ON b.code = rules.code GROUP BY policy),
v AS (SELECT policies.policy, CASE WHEN scope = 'nationwide' THEN 'match/nationwide' WHEN scope IS NULL THEN 'unknown/policy_unknown' WHEN shut > 0 THEN 'mismatch/exclude'
  WHEN near = 0 THEN 'match/exact' WHEN near > 0 THEN 'match/ancestor' WHEN deep > 0 THEN 'match/descendant'
  WHEN coalesce(includes, 0) = 0 OR lost > 0 THEN 'unknown/unresolved_rule' ELSE 'mismatch/other_region' END AS k FROM policies LEFT JOIN per USING (policy))
SELECT policy, split_part(k, '/', 1) AS verdict, split_part(k, '/', 2) AS reason, CASE WHEN scope = 'nationwide' THEN 'match' ELSE 'unknown' END AS lost FROM v JOIN policies USING (policy)""")
def region_verdict(spark, d):
    """Rules with and without a resolved, active region for a region that is there, and the verdict for one that isn't."""
    c = table(spark, d, "customer").withColumn("policy", F.col("c_custkey"))
    scope = F.when(F.col("policy") % 11 == 0, "nationwide").when(F.col("policy") % 7 == 0, F.lit(None)).otherwise("regional")
    p = F.col("policy")
    own = c.where("policy % 13 <> 0").select("policy", F.when(p % 5 == 0, "exclude").otherwise("include").alias("relation"), F.concat(F.lit("n"), "c_nationkey").alias("code"), F.when(p % 34 == 0, "unmapped").otherwise("matched").alias("resolution"), F.when(p % 17 == 0, "retired").otherwise("active").alias("region_status"), F.when(p % 2 == 0, "r2").otherwise("r9").alias("province"))
    wide = c.where("policy % 3 = 0").select("policy", F.lit("include").alias("relation"), F.concat(F.lit("r"), F.col("c_nationkey") % 5).alias("code"), F.when(p % 19 == 0, "ambiguous").otherwise("matched").alias("resolution"), F.lit("active").alias("region_status"), F.lit(None).cast("string").alias("province"))
    rules, tree, base = own.unionByName(wide), verdict.closure(_tree(spark, d)), c.select("policy", scope.alias("scope"))
    lost = verdict.region(base, rules, tree, "nowhere").select("policy", F.col("verdict").alias("lost"))
    return verdict.region(base, rules, tree, "r2", province="r2").join(lost, "policy")


@_query("""WITH b AS (SELECT p_partkey, CAST(substr(p_brand, length(p_brand), 1) AS INTEGER) AS k, p_size, p_partkey % 3 = 0 AS unlimited FROM part),
r AS (SELECT p_partkey, k, p_size, unlimited, CASE WHEN k IN (0, 1, 2) THEN NULL ELSE k * 5 END AS low, CASE WHEN k IN (0, 1, 2, 3) THEN NULL ELSE k * 10 END AS high FROM b)
SELECT p_partkey, CASE WHEN p_size < low OR p_size > high THEN 'mismatch' WHEN low IS NOT NULL OR high IS NOT NULL THEN 'match' WHEN unlimited THEN 'match' ELSE 'unknown' END AS verdict FROM r""")
def three_valued_age(spark, d):
    """Bounds of all kinds; 0 to 0 (k = 0 and 2) counts as none, and a text that names no limit as a match."""
    k = F.substring("p_brand", -1, 1).cast("int")
    low = F.when(k == 1, F.lit(None)).when(k == 2, 0).otherwise(k * 5)
    high = F.when(k.isin(1, 3), F.lit(None)).when(k == 2, 0).otherwise(k * 10)
    said = F.when(F.col("p_partkey") % 3 == 0, "연령  제한 없음").when(F.col("p_partkey") % 3 == 1, "만 19세")
    rows = table(spark, d, "part").select("p_partkey", "p_size", low.alias("low"), high.alias("high"), said.alias("said"))
    return rows.select("p_partkey", verdict.age(F.col("p_size"), F.col("low"), F.col("high"), F.col("said")).alias("verdict"))


@_query("""SELECT o_orderkey, CASE WHEN s IS NULL THEN 'unknown' WHEN s = 'open' THEN 'match' ELSE 'mismatch' END AS status,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'unknown' WHEN o_orderpriority = '1-URGENT' THEN 'match' ELSE 'mismatch' END AS category
FROM (SELECT o_orderkey, o_orderpriority, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'closed' END AS s FROM orders)""")
def three_valued_status_category(spark, d):
    s = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "closed")
    have = F.when(F.col("o_orderpriority") == "5-LOW", F.array().cast("array<string>")).otherwise(F.array("o_orderpriority"))
    return table(spark, d, "orders").select("o_orderkey", verdict.status(s, "open").alias("status"), verdict.category(have, "1-URGENT").alias("category"))


@_query("""SELECT doc_id FROM documents WHERE (coalesce(text ILIKE '%the%', false) OR coalesce(source ILIKE '%the%', false)) AND (coalesce(text ILIKE '%of%', false) OR coalesce(source ILIKE '%of%', false))""")
def text_candidates(spark, d):
    return search.candidates(table(spark, d, "documents"), ["text", "source"], ["the", "지원", "of"]).select("doc_id")


def _hit_sql(field: str) -> str:
    one = "CASE WHEN contains(lower(coalesce({f}, '')), '{t}') OR contains(replace(lower(coalesce({f}, '')), ' ', ''), '{t}') THEN 1 ELSE 0 END"
    return " + ".join(one.format(f=field, t=t) for t in TERMS)


@_query(f"""WITH h AS (SELECT doc_id, {_hit_sql('text')} AS a, {_hit_sql('source')} AS b, {_hit_sql('lang')} AS c FROM documents),
s AS (SELECT doc_id, CAST(a AS BIGINT) AS hits_text, CAST(b AS BIGINT) AS hits_source, CAST(c AS BIGINT) AS hits_lang,
  CAST(1 + 2 * ((a > 0)::INT + (b > 0)::INT + (c > 0)::INT) + a + b + c AS DOUBLE) AS score FROM h)
SELECT *, row_number() OVER (ORDER BY score DESC, hits_text DESC, doc_id) AS rank FROM s QUALIFY rank <= 20""")
def text_score_rank(spark, d):
    """Flagship: relevance over three fields and the twenty best (a top-k report)."""
    docs = table(spark, d, "documents").select("doc_id", "text", "source", "lang")
    scored = search.relevance(docs, ["text", "source", "lang"], TERMS).drop("text", "source", "lang")
    return search.ranked(scored, [F.col("score").desc(), F.col("hits_text").desc(), F.col("doc_id")], top=20)


@_query("""WITH v AS (SELECT p_partkey, CASE WHEN p_type LIKE '%STEEL%' THEN 'match' WHEN p_type LIKE '%TIN%' THEN 'mismatch' ELSE 'unknown' END AS c,
  CASE WHEN p_partkey % 4 = 0 THEN 'match' WHEN p_partkey % 4 = 1 THEN 'mismatch' ELSE 'unknown' END AS r, CASE WHEN p_size < 5 THEN 'mismatch' ELSE 'match' END AS a, p_partkey % 5 AS s FROM part),
s AS (SELECT p_partkey, CAST((c = 'match')::INT * 30 + (r = 'match')::INT * 30 + (a = 'match')::INT * 30 + (s < 2)::INT * 10 AS BIGINT) AS score,
  concat_ws(',', CASE c WHEN 'match' THEN 'category' WHEN 'unknown' THEN 'category?' END, CASE r WHEN 'match' THEN 'region' WHEN 'unknown' THEN 'region?' END, CASE a WHEN 'match' THEN 'age' END, CASE WHEN s < 2 THEN 'open' END) AS reasons
  FROM v WHERE c <> 'mismatch' AND r <> 'mismatch' AND a <> 'mismatch' AND s <> 2)
SELECT *, row_number() OVER (ORDER BY score DESC, p_partkey) AS rank FROM s QUALIFY rank <= 50""")
def recommend_topk(spark, d):
    """Additive scores with exclusions and the fifty best (a top-k report); closed ones are left out, those without a status stay."""
    p, k = table(spark, d, "part"), F.col("p_partkey") % 5
    c = F.when(F.col("p_type").contains("STEEL"), "match").when(F.col("p_type").contains("TIN"), "mismatch").otherwise("unknown")
    r = F.when(F.col("p_partkey") % 4 == 0, "match").when(F.col("p_partkey") % 4 == 1, "mismatch").otherwise("unknown")
    a = F.when(F.col("p_size") < 5, "mismatch").otherwise("match")
    gone, score, reasons = search.recommendation(c, r, a, F.when(k < 2, "open").when(k == 2, "closed").when(k == 3, "scheduled"))
    return search.ranked(p.where(~gone).select("p_partkey", score.alias("score"), reasons.alias("reasons")), [F.col("score").desc(), F.col("p_partkey")], top=50)


@_query("SELECT coalesce(CAST(quality AS VARCHAR), 'null') AS value, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def group_counts_null_bucket(spark, d):
    return audit.with_null_bucket(table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left"), "quality")


@_query(f"""SELECT count(*) AS all_rows, count(*) FILTER (WHERE o_orderstatus = 'O') AS open, count(*) FILTER (WHERE o_orderdate < TIMESTAMP '{AS_OF}') AS past,
  count(*) FILTER (WHERE o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '{AS_OF}') AS unsafe, count(DISTINCT (o_custkey, o_orderstatus)) AS identities FROM orders""")
def conditional_counts(spark, d):
    early, is_open = F.col("o_orderdate") < F.lit(AS_OF).cast("timestamp_ntz"), F.col("o_orderstatus") == "O"
    return table(spark, d, "orders").agg(F.count(F.lit(1)).alias("all_rows"), F.count_if(is_open).alias("open"), F.count_if(early).alias("past"), F.count_if(is_open & early).alias("unsafe"), F.count_distinct("o_custkey", "o_orderstatus").alias("identities"))


_FOLD = "regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]', '', 'g')"


@_query(f"""WITH g AS (SELECT md5({_FOLD}) AS k, count(*) AS n FROM documents GROUP BY 1)
SELECT count(*) FILTER (WHERE n > 1) AS groups, CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS rows_in_groups, max(n) AS largest, count(*) AS keys FROM g""")
def dup_title_groups(spark, d):
    return audit.repeated_groups(table(spark, d, "documents"), F.md5(text.fold(F.col("text"))))


@_query("SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS w FROM conversations) GROUP BY w")
def explode_counts(spark, d):
    words = F.explode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]+"), F.lit(0))).alias("word")
    return table(spark, d, "conversations").select(words).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


_FIELDS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


@_query(" UNION ALL ".join(f"SELECT '{f}' AS field, count({f}) AS present, count(*) - count({f}) AS missing, count(*) FILTER (WHERE CAST({f} AS VARCHAR) = '') AS empty, count({f}) / count(*) AS presence_rate FROM customer" for f in _FIELDS))
def field_profile(spark, d):
    return audit.field_profile(table(spark, d, "customer"), _FIELDS)


@_query(f"""SELECT source, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '{text.EMAIL}'))) AS BIGINT) AS emails, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '{text.PHONE}'))) AS BIGINT) AS phones,
  count(*) FILTER (WHERE regexp_matches(coalesce(text, ''), '{text.EMAIL}') OR regexp_matches(coalesce(text, ''), '{text.PHONE}')) AS unsafe FROM documents GROUP BY source""")
def safety_counts(spark, d):
    t = F.coalesce("text", F.lit(""))
    flags = table(spark, d, "documents").select("source", F.regexp_count(t, F.lit(text.EMAIL)).alias("e"), F.regexp_count(t, F.lit(text.PHONE)).alias("p"))
    return flags.groupBy("source").agg(F.sum("e").alias("emails"), F.sum("p").alias("phones"), F.count_if((F.col("e") > 0) | (F.col("p") > 0)).alias("unsafe"))


@_query("""SELECT coalesce(o_orderpriority, 'total') AS key, count(*) AS n, count(DISTINCT o_custkey) AS customers, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished FROM orders GROUP BY ROLLUP (o_orderpriority)""")
def multi_level_report(spark, d):
    return audit.totals(table(spark, d, "orders"), "o_orderpriority", {"n": F.count(F.lit(1)), "customers": F.count_distinct("o_custkey"), "finished": F.count_if(F.col("o_orderstatus") == "F")})


@_query("""WITH pn AS (SELECT DISTINCT l_partkey, s_nationkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey), one AS (SELECT l_partkey FROM pn GROUP BY 1 HAVING count(*) = 1)
SELECT n_name, count(pn.l_partkey) AS represented, count(one.l_partkey) AS targeted FROM nation LEFT JOIN pn ON s_nationkey = n_nationkey LEFT JOIN one ON one.l_partkey = pn.l_partkey GROUP BY n_name""")
def coverage_represented_targeted(spark, d):
    supplier = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    per = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("l_partkey").agg(F.collect_set("s_nationkey").alias("nations"))
    each = per.select(F.explode("nations").alias("n_nationkey"), (F.size("nations") == 1).alias("only")).groupBy("n_nationkey").agg(F.count(F.lit(1)).alias("represented"), F.count_if("only").alias("targeted"))
    return table(spark, d, "nation").join(each, "n_nationkey", "left").select("n_name", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("represented", "targeted")])


@_query("""WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderkey % 17 <> 0), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'F' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 19 <> 0),
c AS (SELECT coalesce(a.s, 'none') || '->' || coalesce(b.s, 'none') AS change FROM a FULL JOIN b ON a.k = b.k)
SELECT change, count(*) AS n, change IN ('O->F', 'P->F', 'F->F', 'O->O', 'P->P') AS allowed FROM c GROUP BY change""")
def transition_matrix(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))
    new = o.where("k % 19 <> 0").withColumn("s", F.when(F.col("k") % 5 == 0, "F").otherwise(F.col("s")))
    return audit.transitions(o.where("k % 17 <> 0"), new, "k", "s", {("O", "F"), ("P", "F"), ("F", "F"), ("O", "O"), ("P", "P")})


@_query("""SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS place FROM events QUALIFY place <= 20""")
def sample_per_group(spark, d):
    """The latest twenty of each type (a top-k report)."""
    return audit.first_of_each(table(spark, d, "events"), ["event_type"], [F.col("ts").desc(), F.col("event_id").desc()], 20).select("event_type", "event_id", "place")


@_query("SELECT user_id, max(event_id) FILTER (WHERE true) AS newest FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 GROUP BY user_id")
def latest_per_key(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("newest"))


@_query(f"SELECT doc_id, row_number() OVER (PARTITION BY md5({_FOLD}) ORDER BY doc_id) > 1 AS duplicate FROM documents")
def first_occurrence_dedup(spark, d):
    key = F.md5(text.fold(F.col("text")))
    keyed = table(spark, d, "documents").select("doc_id", key.alias("k"))
    first = keyed.groupBy("k").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return audit.met(keyed, first, "k").select("doc_id", F.coalesce(F.col("doc_id") != F.col("first"), F.lit(False)).alias("duplicate"))


_INCOMING = "SELECT c_custkey + CASE WHEN c_custkey % 10 = 0 THEN 10000000 ELSE 0 END AS c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer"


@_query(f"""WITH b AS ({_INCOMING})
SELECT coalesce(b.c_custkey, a.c_custkey) AS c_custkey, coalesce(b.c_name, a.c_name) AS c_name, CASE WHEN b.c_custkey IS NOT NULL THEN b.c_acctbal ELSE a.c_acctbal END AS c_acctbal,
  CASE WHEN a.c_custkey IS NULL THEN 'inserted' WHEN b.c_custkey IS NULL THEN 'absent' WHEN a.c_name IS NOT DISTINCT FROM b.c_name AND a.c_acctbal IS NOT DISTINCT FROM b.c_acctbal THEN 'unchanged' ELSE 'updated' END AS outcome
FROM customer a FULL JOIN b ON a.c_custkey = b.c_custkey""")
def upsert_classify(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    moved = F.col("c_custkey") + F.when(F.col("c_custkey") % 10 == 0, 10_000_000).otherwise(0)
    incoming = c.select(moved.alias("c_custkey"), "c_name", F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")).alias("c_acctbal"))
    return snapshot.upsert(c, incoming, ["c_custkey"], ["c_name", "c_acctbal"])


@_query(f"""SELECT p_partkey, CASE WHEN p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) AND p_partkey % 9 <> 0 THEN DATE '{AS_OF}' END AS inactive_at FROM part""")
def soft_delete_missing(spark, d):
    p = table(spark, d, "part").select("p_partkey")
    seen = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return snapshot.soft_delete(p, seen, p.where("p_partkey % 9 = 0"), "p_partkey", F.lit(AS_OF).cast("date"))


@_query(r"""WITH t AS (SELECT page_id, url, CASE WHEN regexp_extract(url, '\?([^#]*)', 1) = '' THEN [] ELSE list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda q: q <> '' AND NOT starts_with(q, 'utm_'))) END AS q FROM pages)
SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://)', 1)) || lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))
  || regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical FROM t""")
def canonical_url(spark, d):
    return table(spark, d, "pages").select("page_id", text.canonical_url(F.col("url")).alias("canonical"))


@_query()
def visible_text(spark, d):
    return table(spark, d, "pages").select("page_id", text.visible_text("html").alias("visible"))


@_query()
def comparison_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(text.comparable("text"), 256).alias("key"), F.length(text.compatible("text")).alias("n_chars_nfkc"))


_MARKERS = [("law", "license"), ("law", "copyright"), ("contact", "@"), ("secret", "password"), ("junk", "$$$"), ("junk", "###")]


@_query("SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter([" + ", ".join(f"CASE WHEN contains(lower(coalesce(text, '')), '{m}') THEN '{g}' END" for g, m in _MARKERS) + "], lambda x: x IS NOT NULL))), '+') AS groups FROM documents")
def taxonomy_match(spark, d):
    low = F.lower(F.coalesce("text", F.lit("")))
    found = F.array_compact(F.array(*[F.when(low.contains(m), g) for g, m in _MARKERS]))
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(F.array_distinct(found)), "+").alias("groups"))


@_query("""SELECT doc_id, CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty' WHEN toxic = 1 THEN 'reject_toxic' WHEN quality = 0 THEN 'reject_quality' WHEN n_chars < 200 THEN 'review_short' WHEN quality IS NULL THEN 'review_unlabelled' ELSE 'admit' END AS outcome
FROM documents LEFT JOIN labels USING (doc_id)""")
def admission_precedence(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    outcome = F.when(F.col("text").isNull() | (F.trim("text") == ""), "empty").when(F.col("toxic") == 1, "reject_toxic").when(F.col("quality") == 0, "reject_quality").when(F.col("n_chars") < 200, "review_short").when(F.col("quality").isNull(), "review_unlabelled").otherwise("admit")
    return rows.select("doc_id", outcome.alias("outcome"))


_RULES = {"discount_high": "l_discount > 0.09", "late": "l_shipdate > TIMESTAMP '1998-01-01'", "quantity_high": "l_quantity >= 50", "returned": "l_returnflag = 'R'"}


@_query("SELECT l_orderkey, l_linenumber, concat_ws('+', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _RULES.items()) + ") AS issues, CASE WHEN l_quantity >= 50 AND l_discount > 0.09 THEN 'invalid' WHEN " + " OR ".join(_RULES.values()) + " THEN 'partial' ELSE 'valid' END AS quality FROM lineitem")
def quality_classify(spark, d):
    issues = F.array_sort(F.array_compact(F.array(*[F.when(F.expr(c.replace("TIMESTAMP '", "TIMESTAMP_NTZ '")), n) for n, c in _RULES.items()])))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", issues.alias("i"))
    q = F.when(F.array_contains("i", "quantity_high") & F.array_contains("i", "discount_high"), "invalid").when(F.size("i") > 0, "partial").otherwise("valid")
    return rows.select("l_orderkey", "l_linenumber", F.concat_ws("+", "i").alias("issues"), q.alias("quality"))


@_query(f"""SELECT o_orderkey, CASE WHEN DATE '{AS_OF}' < s THEN 'scheduled' WHEN DATE '{AS_OF}' > s + 30 THEN 'closed' ELSE 'open' END AS status, date_diff('day', DATE '{AS_OF}', s + 30) AS days_left,
  CASE WHEN s + 30 < DATE '{AS_OF}' THEN 'past' WHEN s + 30 = DATE '{AS_OF}' THEN 'today' WHEN s + 30 <= DATE '{AS_OF}' + 7 THEN 'imminent' ELSE 'upcoming' END AS kind FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS s FROM orders)""")
def period_status(spark, d):
    start, today = periods.day(F.col("o_orderdate")), F.lit(AS_OF).cast("date")
    end = F.date_add(start, 30)
    return table(spark, d, "orders").select("o_orderkey", periods.period_status(start, end, today).alias("status"), periods.days_left(end, today).alias("days_left"), periods.deadline_kind(end, today).alias("kind"))


@_query("""WITH e AS (SELECT o_orderkey AS id, 'start' AS kind, CAST(o_orderdate AS DATE) AS due FROM orders UNION SELECT l_orderkey, 'end', CAST(l_shipdate AS DATE) FROM lineitem)
SELECT due, count(*) AS n, count(*) FILTER (WHERE kind = 'start') AS starts, CAST(min(id) AS BIGINT) AS first_id FROM e GROUP BY due""")
def dday_calendar(spark, d):
    starts = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit("start").alias("kind"), periods.day(F.col("o_orderdate")).alias("due"))
    ends = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.lit("end").alias("kind"), periods.day(F.col("l_shipdate")).alias("due"))
    return starts.unionByName(ends).distinct().groupBy("due").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "start").alias("starts"), F.min("id").alias("first_id"))


@_query("""WITH m AS (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS m FROM orders)
SELECT m AS month, CAST(unnest(range((m - CAST(dayofweek(m) AS INTEGER))::TIMESTAMP, (m - CAST(dayofweek(m) AS INTEGER) + 42)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS day FROM m""")
def month_grid(spark, d):
    months = table(spark, d, "orders").select(F.trunc(periods.day(F.col("o_orderdate")), "month").alias("month")).distinct()
    return months.select("month", F.explode(periods.month_grid(F.col("month"))).alias("day"))


@_query("SELECT user_id, event_id, CAST((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 12 + 1 AS BIGINT) AS page FROM events")
def page_of_position(spark, d):
    placed = audit.first_of_each(table(spark, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], None)
    return placed.select("user_id", "event_id", (F.floor((F.col("place") - 1) / 12) + 1).alias("page"))


@_query("""SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE lower(event_type) = 'click' AND coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) >= 50""")
def json_log_filter(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", F.from_json("props", "k long", {"mode": "PERMISSIVE"})["k"].alias("k"))
    return e.where((F.lower("event_type") == "click") & (F.coalesce("k", F.lit(0)) >= 50))


_KEY = "regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]', '', 'g')"


@_query(f"""WITH d AS (SELECT doc_id, lang, {_KEY} AS k FROM documents), c AS (SELECT md5(k) AS h, count(*) AS n, count(DISTINCT lang) AS langs, min(doc_id) AS first FROM d WHERE k <> '' GROUP BY 1)
SELECT doc_id, CASE WHEN k = '' THEN 'review_incomplete' WHEN n = 1 THEN 'unique' WHEN langs > 1 THEN 'review_conflict' WHEN doc_id = first THEN 'keep_first' ELSE 'exact_duplicate' END AS decision FROM d LEFT JOIN c ON c.h = md5(k)""")
def dedup_precedence(spark, d):
    """Precedence of duplicate decisions over full fingerprints; copies are settled from one row a fingerprint."""
    keyed = table(spark, d, "documents").select("doc_id", "lang", text.fold(F.col("text")).alias("t")).select("doc_id", "lang", (F.col("t") == "").alias("blank"), F.md5("t").alias("h"))
    per = keyed.where("NOT blank").groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("lang").alias("langs"), F.min("doc_id").alias("first")).where("n > 1")
    decision = F.when(F.col("blank"), "review_incomplete").when(F.col("n").isNull(), "unique").when(F.col("langs") > 1, "review_conflict").when(F.col("doc_id") == F.col("first"), "keep_first").otherwise("exact_duplicate")
    return audit.met(keyed, per, "h").select("doc_id", decision.alias("decision"))


@_query("""WITH k AS (SELECT sha256(CAST(o_orderkey AS VARCHAR) || '/' || o_orderstatus) AS k FROM orders), w AS (SELECT greatest(1, CAST(ceil(ln(count(*) / 4096.0) / ln(16)) AS BIGINT)) AS w FROM k), b AS (SELECT substr(k, 1, w) AS p, sha256(string_agg(k, ',' ORDER BY k)) AS h, count(*) AS n FROM k, w GROUP BY 1)
SELECT sha256(string_agg(h, ',' ORDER BY p)) AS root, CAST(sum(n) AS BIGINT) AS identities FROM b""")
def identity_hash(spark, d):
    """One hash over all sorted identities, by way of a hash for each prefix of so many digits that about 4,096 identities share one
    at most: no task sorts them all."""
    ids = table(spark, d, "orders").select(F.sha2(F.concat_ws("/", F.col("o_orderkey").cast("string"), "o_orderstatus"), 256).alias("k"))
    digits = max(1, math.ceil(math.log(max(1, ids.count()) / 4096, 16)))
    part = ids.groupBy(F.substring("k", 1, digits).alias("p")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("k")), ","), 256).alias("h"), F.count(F.lit(1)).alias("n"))
    whole = part.agg(F.array_sort(F.collect_list(F.struct("p", "h"))).alias("l"), F.sum("n").alias("identities"))
    return whole.select(F.sha2(F.array_join("l.h", ","), 256).alias("root"), "identities")


@_query(f"""WITH o AS (SELECT o_orderkey, o_orderkey % 8 AS k, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + 45 AS e FROM orders)
SELECT o_orderkey, CASE WHEN k IN (0, 1, 6) THEN s WHEN k = 3 THEN date_trunc('month', s)::DATE END AS start_day, CASE WHEN k IN (0, 6) THEN e WHEN k = 2 THEN s WHEN k = 3 THEN last_day(e) END AS end_day,
  CASE WHEN k IN (0, 1, 2, 3, 6) THEN 'fixed_period' WHEN k = 4 THEN 'always' END AS schedule,
  CASE WHEN k IN (0, 6) THEN CASE WHEN DATE '{AS_OF}' < s THEN 'scheduled' WHEN DATE '{AS_OF}' > e THEN 'closed' ELSE 'open' END WHEN k = 1 AND DATE '{AS_OF}' < s THEN 'scheduled'
    WHEN k = 2 THEN CASE WHEN DATE '{AS_OF}' > s THEN 'closed' ELSE 'open' END WHEN k = 3 THEN CASE WHEN DATE '{AS_OF}' < date_trunc('month', s) THEN 'scheduled' WHEN DATE '{AS_OF}' > last_day(e) THEN 'closed' ELSE 'open' END
    WHEN k = 4 THEN 'open' END AS status,
  CASE WHEN k = 5 THEN 'invalid_application_date_order' WHEN k = 6 THEN 'extra_application_dates' WHEN k = 7 THEN 'unparsed_application_period' END AS issue FROM o""")
def parsed_period(spark, d):
    """Periods written out in eight ways and parsed again; the SQL side never sees the text."""
    s = periods.day(F.col("o_orderdate"))
    e, k = F.date_add(s, 45), F.col("o_orderkey") % 8
    dot, flat, month = (lambda c: F.date_format(c, "yyyy.MM.dd")), (lambda c: F.date_format(c, "yyyyMMdd")), (lambda c: F.date_format(c, "yyyy년 M월"))
    ways = [F.concat_ws(" ~ ", dot(s), dot(e)), F.concat(dot(s), F.lit(" 부터")), F.concat(flat(s), F.lit("까지")), F.concat_ws("~", month(s), month(e)), F.lit("상시 접수"), F.concat_ws("~", dot(e), dot(s)), F.concat_ws(" ~ ", flat(s), flat(e), flat(e)), F.lit("추후 공지")]
    written = F.element_at(F.array(*ways), (k + 1).cast("int"))
    rows = table(spark, d, "orders").select("o_orderkey", written.alias("text"))
    return parsing.each_once(rows, "text", "p", lambda c: parsing.period(c, F.lit(AS_OF).cast("date"))).select("o_orderkey", F.col("p.start").alias("start_day"), F.col("p.end").alias("end_day"), "p.schedule", "p.status", "p.issue")


@_query("""WITH p AS (SELECT p_partkey, p_partkey % 6 AS k, p_size AS n FROM part)
SELECT p_partkey, CASE WHEN k IN (0, 1) THEN n END AS low, CASE WHEN k = 0 THEN n + 15 WHEN k = 2 THEN n END AS high, CASE WHEN k = 3 THEN 'unparsed_age_condition' WHEN k = 4 THEN 'invalid_age_range' END AS issue, CASE WHEN k = 5 THEN NULL ELSE n END AS asked FROM p""")
def parsed_age(spark, d):
    """Age limits written out in six ways and parsed again."""
    n, k = F.col("p_size"), F.col("p_partkey") % 6
    ways = [F.concat(F.lit("만 "), n, F.lit("세 ~ "), n + 15, F.lit("세")), F.concat(n, F.lit("세 이상")), F.concat(n, F.lit("세 이하")), F.concat(F.lit("약 "), n, F.lit("세")), F.concat(n, F.lit("세~"), F.lit(0), F.lit("세")), F.lit("제한 없음")]
    written = F.element_at(F.array(*ways), (k + 1).cast("int"))
    rows = table(spark, d, "part").select("p_partkey", parsing.age_limits(written).alias("a"), parsing.asked_age(written).alias("asked"))
    return rows.select("p_partkey", "a.low", "a.high", "a.issue", "asked")


@_query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS UNBOUNDED PRECEDING) AS section FROM conversations""")
def section_carry_forward(spark, d):
    turns = table(spark, d, "conversations").withColumn("head", F.when(F.col("role") == "user", F.col("turn")))
    return release.carried(turns, ["conv_id"], ["turn", "text"], "head", "section").select("conv_id", "turn", "section")


@_query("""WITH nodes AS (SELECT 'n' || n_nationkey AS code, CASE WHEN n_nationkey % 6 = 1 THEN 'x' || n_nationkey WHEN n_nationkey % 6 = 2 THEN 'n' || n_nationkey ELSE 'r' || n_regionkey END AS parent FROM nation UNION ALL SELECT 'r' || r_regionkey, NULL FROM region UNION ALL SELECT 'r1', NULL)
SELECT code, 'duplicate_code' AS fault FROM nodes GROUP BY code HAVING count(*) > 1 UNION ALL SELECT code, 'own_parent' FROM nodes WHERE code = parent
UNION ALL SELECT code, 'unknown_parent' FROM nodes WHERE parent IS NOT NULL AND parent NOT IN (SELECT code FROM nodes) UNION ALL SELECT NULL, 'root_count' FROM nodes HAVING count(*) FILTER (WHERE parent IS NULL) <> 1""")
def reference_integrity(spark, d):
    k, n = F.col("n_nationkey"), F.concat(F.lit("n"), "n_nationkey")
    parent = F.when(k % 6 == 1, F.concat(F.lit("x"), k)).when(k % 6 == 2, n).otherwise(F.concat(F.lit("r"), "n_regionkey"))
    nations = table(spark, d, "nation").select(n.alias("code"), parent.alias("parent"))
    regions = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("code"), F.lit(None).cast("string").alias("parent"))
    again = spark.createDataFrame([("r1", None)], "code string, parent string")
    return integrity.tree_faults(nations.unionByName(regions).unionByName(again))


@_query("""WITH r AS (SELECT o_custkey AS k, o_orderkey AS run, o_orderstatus AS s, o_orderdate AS t FROM orders)
SELECT c_custkey AS k, c_name, (SELECT count(*) FROM r WHERE k = c_custkey) AS n, l.run AS latest_run, a.run AS active_run FROM customer
LEFT JOIN (SELECT k, run FROM r QUALIFY row_number() OVER (PARTITION BY k ORDER BY t DESC, run DESC) = 1) l ON l.k = c_custkey
LEFT JOIN (SELECT k, run FROM r WHERE s = 'O' QUALIFY row_number() OVER (PARTITION BY k ORDER BY t DESC, run DESC) = 1) a ON a.k = c_custkey""")
def admin_status_view(spark, d):
    runs = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("run"), "o_orderstatus", "o_orderdate")
    catalog = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_name")
    return integrity.status_view(catalog, runs, runs, "k", [F.col("o_orderdate").desc(), F.col("run").desc()], F.col("o_orderstatus") == "O")


@_query(r"""SELECT o_orderkey, 'BEGIN:VEVENT' || chr(13) || chr(10) || 'UID:' || o_orderkey || '@orders' || chr(13) || chr(10) || 'DTSTART;VALUE=DATE:' || strftime(o_orderdate, '%Y%m%d') || chr(13) || chr(10)
  || 'DTEND;VALUE=DATE:' || strftime(CAST(o_orderdate AS DATE) + 1, '%Y%m%d') || chr(13) || chr(10) || 'SUMMARY:' || o_orderpriority || '\, due\; ' || o_orderstatus || chr(13) || chr(10) || 'END:VEVENT' AS event FROM orders""")
def calendar_export(spark, d):
    title = F.concat("o_orderpriority", F.lit(", due; "), "o_orderstatus")
    uid = F.concat(F.col("o_orderkey").cast("string"), F.lit("@orders"))
    return table(spark, d, "orders").select("o_orderkey", integrity.calendar_event(uid, periods.day(F.col("o_orderdate")), title).alias("event"))


@_query(f"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(coalesce(text, ''), '{text.EMAIL}', '', 'g'), '{text.PHONE}', '', 'g'))) AS cleaned FROM documents""")
def contact_cleanup(spark, d):
    t = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), text.EMAIL, ""), text.PHONE, "")
    return table(spark, d, "documents").select("doc_id", F.md5(F.trim(t)).alias("cleaned"))
