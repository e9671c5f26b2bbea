"""Registered queries of search, regions, normalisation, validation, decisions, gates and display, with their SQL.

Their input is a policy table written out from ``part`` by SQL that both engines read, over all of its rows; the operators
then work on it, and the SQL side states the expected answers in its own words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightweir.catalog_queries import _query, _tree
from brightweir.functions import parsing, periods, text
from brightweir.operators import audit, decide, display, gates, integrity, normalize, postings, search, snapshot, validate, verdict
from brightweir.session import cut, scratch, table

TODAY = "1996-06-15"

POLICIES = """SELECT p_partkey AS id, 'src' || CAST(p_partkey % 4 AS STRING) AS source_id, CASE WHEN p_partkey % 37 <> 0 THEN 'e' || CAST(p_partkey AS STRING) END AS external_id,
  p_name || ' ' || CAST(p_partkey % 97 AS STRING) AS title, CASE WHEN p_partkey % 9 <> 0 THEN p_type || ' ' || p_brand END AS summary,
  CASE WHEN p_partkey % 11 <> 0 THEN 'Org ' || CAST(p_partkey % 13 AS STRING) END AS organization, CASE WHEN p_partkey % 17 <> 0 THEN p_brand || ' support' ELSE '' END AS support_content,
  CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'housing' WHEN 2 THEN 'finance,welfare' WHEN 3 THEN 'employment' WHEN 4 THEN 'education,other' ELSE 'startup' END AS cats,
  CASE p_partkey % 7 WHEN 0 THEN '' WHEN 1 THEN '전국' WHEN 2 THEN 'r1' WHEN 3 THEN 'r1,n1' WHEN 4 THEN 'r2,n2,n7' ELSE 'n3' END AS regs,
  CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 5 = 1 THEN 0 ELSE CAST(18 + p_partkey % 7 AS INT) END AS age_min, CASE WHEN p_partkey % 5 IN (0, 3) THEN NULL WHEN p_partkey % 5 = 1 THEN 0 ELSE CAST(30 + p_partkey % 11 AS INT) END AS age_max,
  CASE p_partkey % 10 WHEN 5 THEN '연령 제한 없음' WHEN 0 THEN NULL ELSE '만 19세' END AS age_text,
  CASE WHEN p_partkey % 8 <> 0 THEN DATE '1996-01-01' + CAST(p_partkey % 300 AS INT) END AS application_start, CASE WHEN p_partkey % 8 NOT IN (0, 1) THEN DATE '1996-02-01' + CAST(p_partkey % 300 AS INT) END AS application_end,
  CASE WHEN p_partkey % 8 <> 0 THEN 'fixed_period' WHEN p_partkey % 3 = 0 THEN 'always' WHEN p_partkey % 3 = 1 THEN 'until_budget_exhausted' END AS schedule,
  CASE WHEN p_partkey % 12 = 0 THEN 'closed' WHEN p_partkey % 12 <= 5 THEN 'open' WHEN p_partkey % 12 <= 7 THEN 'scheduled' END AS status,
  CASE WHEN p_partkey % 23 = 0 THEN 'invalid' WHEN p_partkey % 3 = 0 THEN 'partial' ELSE 'valid' END AS quality, CASE WHEN p_partkey % 19 <> 0 THEN p_type || ' period' END AS period_text,
  CASE WHEN p_partkey % 7 = 1 THEN 'nationwide' WHEN p_partkey % 7 = 0 THEN 'unknown' ELSE 'regional' END AS scope, DATE '1996-05-01' + CAST(p_partkey % 40 AS INT) AS collected_at FROM {part}"""
_P = "p AS (" + POLICIES.replace("{part}", "part") + ")"
_CATS = "CASE WHEN cats = '' THEN [] ELSE string_split(cats, ',') END"
_REGS = "CASE WHEN regs = '' THEN [] ELSE string_split(regs, ',') END"
_LO, _HI = "CASE WHEN age_min = 0 AND age_max = 0 THEN NULL ELSE age_min END", "CASE WHEN age_min = 0 AND age_max = 0 THEN NULL ELSE age_max END"


def _age_sql(age: int) -> str:
    return f"CASE WHEN {age} < ({_LO}) OR {age} > ({_HI}) THEN 'mismatch' WHEN ({_LO}) IS NOT NULL OR ({_HI}) IS NOT NULL THEN 'match' WHEN age_text LIKE '%제한 없음%' THEN 'match' ELSE 'unknown' END"


def policies(spark, d) -> DataFrame:
    rows = spark.sql(POLICIES, part=table(spark, d, "part"))
    listed = lambda c: F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, ","))
    return rows.withColumns({"categories": listed("cats"), "regions": listed("regs")})


# Search ---------------------------------------------------------------------------------------------------------------
_ASKED = search.Request(terms=["지원", "economy"], age=25, category="housing", wanted_categories=("housing", "startup"), wanted_age=20)
_REGION_VERDICT = """CASE WHEN scope = 'nationwide' THEN 'match' WHEN scope = 'unknown' THEN 'unknown' WHEN id % 7 IN (2, 3) THEN 'match' ELSE 'mismatch' END"""
_FULL = f"""WITH {_P}, q AS (SELECT *, {_CATS} AS cl, {_REGS} AS rl, {_age_sql(25)} AS age_verdict, {_age_sql(20)} AS liked_age, {_REGION_VERDICT} AS region_verdict,
  concat_ws(' ', title, CASE WHEN cats <> '' THEN replace(cats, ',', ' ') END, summary, age_text, CASE WHEN support_content <> '' THEN support_content END) AS search_text FROM p WHERE quality <> 'invalid' AND coalesce(status <> 'closed', true)),
f AS (SELECT *, CASE WHEN len(cl) = 0 THEN 'unknown' WHEN list_contains(cl, 'housing') THEN 'match' ELSE 'mismatch' END AS category_verdict FROM q
  WHERE (search_text ILIKE '%economy%' OR title ILIKE '%economy%' OR coalesce(summary ILIKE '%economy%', false))),
h AS (SELECT *, CAST(contains(lower(title), 'economy') AS INT) + CAST(contains(lower(title), '지원') AS INT) AS h1,
  CAST(contains(lower(coalesce(summary, '')), 'economy') AS INT) AS h2, CAST(contains(lower(support_content), 'economy') AS INT) AS h3 FROM f
  WHERE age_verdict <> 'mismatch' AND category_verdict <> 'mismatch' AND region_verdict <> 'mismatch'),
s AS (SELECT id, age_verdict, category_verdict, region_verdict, CAST(1 + 2 * ((h1 > 0)::INT + (h2 > 0)::INT + (h3 > 0)::INT) + h1 + h2 + h3 AS DOUBLE) AS score,
  CAST((len(list_intersect(cl, ['housing', 'startup'])) > 0)::INT + (liked_age = 'match')::INT AS INT) AS preference_matches, CAST((len(cl) = 0)::INT + (liked_age = 'unknown')::INT AS INT) AS preference_unknowns,
  CAST(CASE region_verdict WHEN 'unknown' THEN 2 WHEN 'match' THEN CASE WHEN scope = 'nationwide' THEN 1 ELSE 0 END END AS INT) AS region_group, CAST(CASE WHEN region_verdict = 'match' AND scope <> 'nationwide' THEN greatest(len(rl), 1) ELSE 1000000 END AS INT) AS region_breadth,
  CAST((age_verdict = 'unknown')::INT + (category_verdict = 'unknown')::INT + (region_verdict = 'unknown')::INT AS INT) AS unknown_count, CAST(CASE status WHEN 'open' THEN 0 WHEN 'scheduled' THEN 1 ELSE 2 END AS INT) AS status_rank, lower(title) AS lt, application_end AS due FROM h)"""
_FULL_ORDER = "score DESC, preference_matches DESC, preference_unknowns, region_group, region_breadth, unknown_count, status_rank, id"


_KEPT: dict[tuple[str, str, str], str] = {}


def _kept(spark, d, name: str, write) -> str:
    """Path of a derived table, written once a session and folder: searches read it, they don't build it."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _KEPT:
        path = scratch(spark, name)
        write(path)
        _KEPT[key] = path
    return _KEPT[key]


def projection(spark, d) -> DataFrame:
    """The policies with their search texts, as persisted."""
    return spark.read.parquet(_kept(spark, d, "projection", lambda path: search.search_document(policies(spark, d)).write.parquet(path)))


def index(spark, d) -> str:
    """Postings of the projection's texts."""
    return _kept(spark, d, "postings", lambda path: postings.add(projection(spark, d), path, ["search_text", "title", "summary"], 0))


def _evaluated(spark, d) -> DataFrame:
    rows = projection(spark, d)
    reason = F.when(F.col("scope") == "nationwide", "nationwide").when(F.col("scope") == "unknown", "policy_unknown").otherwise("exact")
    v = F.when(F.col("scope") == "nationwide", "match").when(F.col("scope") == "unknown", "unknown").when((F.col("id") % 7).isin(2, 3), "match").otherwise("mismatch")
    regions = rows.select(F.col("id").alias("policy"), v.alias("verdict"), reason.alias("reason"))
    return search.evaluate(rows, search.Request(**(_ASKED.__dict__ | {"region": "r1"})), regions)


@_query(f"{_FULL} SELECT id, age_verdict, category_verdict, region_verdict, score, preference_matches, preference_unknowns, region_group, region_breadth, unknown_count, status_rank, row_number() OVER (ORDER BY {_FULL_ORDER}) AS rank FROM s QUALIFY rank <= 100")
def search_full_order(spark, d):
    """Evaluation with every condition and the whole default order; the hundred best (a top-k report)."""
    keep = ["id", "age_verdict", "category_verdict", "region_verdict", "score", "preference_matches", "preference_unknowns", "region_group", "region_breadth", "unknown_count", "status_rank"]
    out = _evaluated(spark, d)
    return search.ranked(out, search.default_order(), top=100).select(*keep, "rank")


@_query(f"{_FULL} SELECT id, row_number() OVER (ORDER BY {_FULL_ORDER}) AS rank, (SELECT count(*) FROM s) AS total FROM s QUALIFY rank BETWEEN 11 AND 20")
def search_total_page(spark, d):
    """The second page of ten with the total (a page report)."""
    return search.page(_evaluated(spark, d), search.default_order(), 2, 10).select("id", "rank", "total")


@_query(f"""{_FULL} SELECT 'title_desc' AS sort, id, row_number() OVER (ORDER BY lt DESC, {_FULL_ORDER}) AS rank FROM s QUALIFY rank <= 40
UNION ALL SELECT 'deadline_asc', id, row_number() OVER (ORDER BY due NULLS LAST, {_FULL_ORDER}) AS rank FROM s QUALIFY rank <= 40""")
def search_user_sorts(spark, d):
    """A chosen sort over the default order, which settles ties; the forty best of each (a top-k report)."""
    rows = _evaluated(spark, d)
    each = [search.ranked(rows, search.user_order(s), top=40).select(F.lit(s).alias("sort"), "id", "rank") for s in ("title_desc", "deadline_asc")]
    return each[0].unionByName(each[1])


_SORTS = {"title_asc": "lower(title)", "title_desc": "lower(title) DESC", "deadline_asc": "application_end NULLS LAST", "deadline_desc": "application_end DESC NULLS LAST", "collected_desc": "collected_at DESC", "collected_asc": "collected_at", "nonsense": "0"}


@_query(f"WITH {_P} " + " UNION ALL ".join(f"SELECT '{s}' AS sort, id, row_number() OVER (ORDER BY {k}, id) AS rank FROM p QUALIFY rank <= 30" for s, k in _SORTS.items()))
def listed_sorts(spark, d):
    """Each allowed sort of the public list, and a name that isn't allowed; the thirty first (a top-k report)."""
    rows, out = policies(spark, d), None
    for s in _SORTS:
        one = search.ranked(rows, search.listed_order(s), top=30).select(F.lit(s).alias("sort"), "id", "rank")
        out = one if out is None else out.unionByName(one)
    return out


@_query(f"""WITH {_P} SELECT id, title AS title_text, CASE WHEN cats = '' THEN '' ELSE replace(cats, ',', ' ') END AS keyword_text, coalesce(summary, '') AS summary_text, coalesce(age_text, '') AS eligibility_text, support_content AS support_text,
  concat_ws(' ', title, CASE WHEN cats <> '' THEN replace(cats, ',', ' ') END, summary, age_text, CASE WHEN support_content <> '' THEN support_content END) AS search_text FROM p""")
def search_projection(spark, d):
    return search.search_document(policies(spark, d)).select("id", *search.FIELDS, "search_text")


@_query(f"""WITH {_P}, a AS (SELECT id, title, DATE '1996-07-01' + CAST(id % 3 AS INT) AS at FROM p WHERE id % 5 <> 0), b AS (SELECT id, CASE WHEN id % 4 = 0 THEN title || '!' ELSE title END AS title FROM p)
SELECT b.id, CASE WHEN a.id IS NULL THEN 'inserted' WHEN a.title = b.title THEN 'unchanged' ELSE 'updated' END AS outcome, CASE WHEN a.title = b.title THEN a.at ELSE greatest(a.at, DATE '1996-07-02') END AS updated_at FROM b LEFT JOIN a ON a.id = b.id""")
def projection_sync(spark, d):
    p = policies(spark, d)
    old = p.where("id % 5 <> 0").select("id", "title", F.date_add(F.lit("1996-07-01").cast("date"), (F.col("id") % 3).cast("int")).alias("updated_at"))
    new = p.select("id", F.when(F.col("id") % 4 == 0, F.concat("title", F.lit("!"))).otherwise(F.col("title")).alias("title"))
    return search.sync(old, new, "id", ["title"], F.lit("1996-07-02").cast("date")).select("id", "outcome", "updated_at")


@_query(f"""WITH {_P}, v AS (SELECT *, {_CATS} AS cl, {_REGS} AS rl, {_age_sql(25)} AS a, {_REGION_VERDICT} AS r FROM p WHERE quality <> 'invalid'),
s AS (SELECT id, CASE WHEN len(cl) = 0 THEN 'unknown' WHEN list_contains(cl, 'housing') THEN 'match' ELSE 'mismatch' END AS c, a, r, status, scope, rl FROM v),
k AS (SELECT id, CAST((c = 'match')::INT * 30 + (r = 'match')::INT * 30 + (a = 'match')::INT * 30 + coalesce(status = 'open', false)::INT * 10 AS BIGINT) AS score,
  CAST(CASE WHEN r = 'unknown' THEN 3 WHEN scope = 'nationwide' THEN 2 ELSE 0 END AS INT) AS region_group, CAST(CASE WHEN r = 'match' AND scope <> 'nationwide' THEN greatest(len(rl), 1) ELSE 1000000 END AS INT) AS breadth
  FROM s WHERE c <> 'mismatch' AND a <> 'mismatch' AND r <> 'mismatch' AND coalesce(status <> 'closed', true))
SELECT id, score, region_group, row_number() OVER (ORDER BY score DESC, region_group, breadth, id) AS rank FROM k QUALIFY rank <= 50""")
def recommend_regional(spark, d):
    """Recommendations for an age, a category and a region; the fifty best (a top-k report)."""
    p = policies(spark, d).where("quality <> 'invalid'")
    v = F.when(F.col("scope") == "nationwide", "match").when(F.col("scope") == "unknown", "unknown").when((F.col("id") % 7).isin(2, 3), "match").otherwise("mismatch")
    gone, score, _ = search.recommendation(verdict.category(F.col("categories"), "housing"), v, verdict.age(F.lit(25), F.col("age_min"), F.col("age_max"), F.col("age_text")), F.col("status"))
    group, breadth = search.recommended_region_key(True, v, F.col("scope"), F.size("regions"))
    rows = p.where(~gone).select("id", score.alias("score"), group.alias("region_group"), breadth.alias("breadth"))
    return search.ranked(rows, [F.col("score").desc(), F.col("region_group"), F.col("breadth"), F.col("id")], top=50).drop("breadth")


@_query(f"""WITH {_P} SELECT id, source_id, coalesce(external_id, '') AS external_id, CASE WHEN cats <> '' THEN string_split(cats, ',')[1] ELSE '기타' END AS category, strftime(application_start, '%Y-%m-%d') AS application_start,
  strftime(application_end, '%Y-%m-%d') AS application_end, coalesce(status, 'unknown') AS status FROM p""")
def recommended_items(spark, d):
    return search.recommended_item(policies(spark, d).withColumn("category_text", F.lit(None).cast("string")))


# Regions --------------------------------------------------------------------------------------------------------------
@_query("""SELECT c_custkey AS key, CASE n WHEN 0 THEN 'unmapped' WHEN 1 THEN 'matched' ELSE 'ambiguous' END AS state, codes FROM (SELECT c_custkey, count(x.code) AS n, coalesce(string_agg(x.code, ',' ORDER BY x.code), '') AS codes
FROM customer LEFT JOIN (SELECT n_name AS name, 'n' || n_nationkey AS code FROM nation UNION SELECT r_name, 'r' || r_regionkey FROM region UNION SELECT 'NATION_3', 'n4' FROM nation) x ON x.name = CASE c_custkey % 3 WHEN 0 THEN 'NATION_' || c_nationkey WHEN 1 THEN 'ASIA' ELSE 'X' || c_nationkey END GROUP BY c_custkey)""")
def alias_resolution(spark, d):
    """Names of regions to codes: none, one or several."""
    n = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.concat(F.lit("n"), "n_nationkey").alias("code"))
    r = table(spark, d, "region").select(F.col("r_name").alias("name"), F.concat(F.lit("r"), "r_regionkey").alias("code"))
    names = n.unionByName(r).unionByName(spark.createDataFrame([("NATION_3", "n4")], "name string, code string"))
    k = F.col("c_custkey") % 3
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.when(k == 0, F.concat(F.lit("NATION_"), "c_nationkey")).when(k == 1, "ASIA").otherwise(F.concat(F.lit("X"), "c_nationkey")).alias("name"))
    return normalize.resolve(asked, names).select("key", "state", F.array_join("codes", ",").alias("codes"))


@_query("""WITH q AS (SELECT c_custkey AS key, CASE c_custkey % 4 WHEN 0 THEN 'living in NATION_' || c_nationkey || ' now' WHEN 1 THEN 'ASIA or NATION_2' WHEN 2 THEN 'NATION_1' || (c_nationkey % 10) ELSE c_name END AS t FROM customer),
x AS (SELECT n_name AS name, 1 AS tier FROM nation UNION SELECT r_name, 2 FROM region), m AS (SELECT key, name, row_number() OVER (PARTITION BY key ORDER BY tier, -length(name), name) AS r FROM q JOIN x ON contains(t, name))
SELECT q.key, m.name FROM q LEFT JOIN m ON m.key = q.key AND r = 1""")
def region_mention(spark, d):
    """The region that a question names: lowest tier, then longest name."""
    c, k = table(spark, d, "customer"), F.col("c_custkey") % 4
    said = F.when(k == 0, F.concat(F.lit("living in NATION_"), "c_nationkey", F.lit(" now"))).when(k == 1, "ASIA or NATION_2").when(k == 2, F.concat(F.lit("NATION_1"), F.col("c_nationkey") % 10)).otherwise(F.col("c_name"))
    names = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.lit(1).alias("tier")).unionByName(table(spark, d, "region").select(F.col("r_name").alias("name"), F.lit(2).alias("tier")))
    return normalize.mention(c.select(F.col("c_custkey").alias("key"), said.alias("text")), names)


@_query("""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '수원' WHEN 1 THEN NULL WHEN 2 THEN '세종' WHEN 3 THEN NULL ELSE '강남' END AS short, CASE c_custkey % 5 WHEN 0 THEN 'rent,' || c_nationkey WHEN 1 THEN '' ELSE 'help' END AS terms FROM customer""")
def question_terms(spark, d):
    """Names without their endings, and the words of a question that nothing else has used."""
    k = F.col("c_custkey") % 5
    name = F.when(k == 0, "수원시").when(k == 1, "중구").when(k == 2, "세종특별자치시").when(k == 3, "ASIA").otherwise("강남구")
    said = F.when(k == 0, F.concat(F.lit(" 수원시 사는 (rent) "), F.col("c_nationkey"), F.lit("!"))).when(k == 1, "있나요 중구, 중구청").otherwise("알려줘 [help] region1")
    consumed = F.array(F.when(k == 0, "수원").when(k == 1, "중구").otherwise("region"))
    return table(spark, d, "customer").select("c_custkey", normalize.without_suffix(name).alias("short"), F.array_join(normalize.unread_terms(said, consumed), ",").alias("terms"))


@_query("""WITH e AS (SELECT c_custkey AS policy, 0 AS pos, 'include' AS relation, CASE WHEN c_custkey % 6 = 0 THEN 'nowhere' ELSE 'NATION_' || c_nationkey END AS t FROM customer
  UNION ALL SELECT c_custkey, 1, CASE WHEN c_custkey % 5 = 0 THEN 'exclude' ELSE 'include' END, CASE WHEN c_custkey % 4 = 0 THEN 'twice' ELSE 'ASIA' END FROM customer WHERE c_custkey % 2 = 0),
x AS (SELECT n_name AS name, 'n' || n_nationkey AS code FROM nation UNION SELECT r_name, 'r' || r_regionkey FROM region UNION SELECT 'twice', 'n1' UNION SELECT 'twice', 'n2'),
m AS (SELECT policy, pos, relation, t, count(code) AS n, min(code) AS code FROM e LEFT JOIN x ON x.name = e.t GROUP BY ALL)
SELECT policy, coalesce(string_agg(CASE WHEN n = 1 AND relation = 'include' THEN t END, ',' ORDER BY pos), '') AS regions, CASE WHEN count(*) FILTER (WHERE n = 1 AND relation = 'include') > 0 THEN 'regional' ELSE 'unknown' END AS scope,
  string_agg(relation || '/' || CASE n WHEN 0 THEN 'unmapped/' || t WHEN 1 THEN 'matched/' || code ELSE 'ambiguous/' || t END, ',' ORDER BY pos) AS rules, coalesce(string_agg(CASE WHEN n > 1 THEN 'ambiguous_region' WHEN n = 0 THEN 'unmapped_region_code' END, ',' ORDER BY pos), '') AS issues FROM m GROUP BY policy""")
def region_contracts(spark, d):
    c = table(spark, d, "customer").withColumnRenamed("c_custkey", "policy")
    one = c.select("policy", F.lit(0).alias("pos"), F.lit("include").alias("relation"), F.when(F.col("policy") % 6 == 0, "nowhere").otherwise(F.concat(F.lit("NATION_"), "c_nationkey")).alias("source_text"))
    two = c.where("policy % 2 = 0").select("policy", F.lit(1).alias("pos"), F.when(F.col("policy") % 5 == 0, "exclude").otherwise("include").alias("relation"), F.when(F.col("policy") % 4 == 0, "twice").otherwise("ASIA").alias("source_text"))
    again = one.withColumn("pos", F.lit(2))  # repeats of the first rule count once
    n = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.concat(F.lit("n"), "n_nationkey").alias("code"), F.col("n_name").alias("full_name"))
    r = table(spark, d, "region").select(F.col("r_name").alias("name"), F.concat(F.lit("r"), "r_regionkey").alias("code"), F.col("r_name").alias("full_name"))
    both = spark.createDataFrame([("twice", "n1", "a"), ("twice", "n2", "b")], "name string, code string, full_name string")
    out = normalize.region_contract(one.unionByName(two).unionByName(again), n.unionByName(r).unionByName(both))
    return out.select("policy", F.array_join("regions", ",").alias("regions"), "scope", F.array_join("rules", ",").alias("rules"), F.array_join("issues", ",").alias("issues"))


@_query("""WITH RECURSIVE nodes AS (SELECT 'world' AS code, CAST(NULL AS VARCHAR) AS parent, CAST(NULL AS VARCHAR) AS agg UNION ALL SELECT 'r' || r_regionkey, 'world', NULL FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, CASE WHEN n_nationkey >= 5 THEN 'n' || (n_nationkey % 5) END FROM nation),
c AS (SELECT code, code AS ancestor, 0 AS distance FROM nodes UNION ALL SELECT c.code, coalesce(n.agg, n.parent), c.distance + 1 FROM c JOIN nodes n ON n.code = c.ancestor WHERE coalesce(n.agg, n.parent) IS NOT NULL)
SELECT code, ancestor, distance FROM c""")
def aggregate_closure(spark, d):
    """Ancestors by the aggregate parent where there is one."""
    k = F.col("n_nationkey")
    base = _tree(spark, d).withColumn("aggregate_parent", F.lit(None).cast("string")).where("code NOT LIKE 'n%'")
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), k).alias("code"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.when(k >= 5, F.concat(F.lit("n"), k % 5)).alias("aggregate_parent"))
    return verdict.closure(base.unionByName(n))


@_query("""SELECT 'n' || n_nationkey AS code, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'n' || n_nationkey, 'n' || (n_nationkey % 5) FROM nation WHERE n_nationkey >= 5""")
def parent_edges(spark, d):
    k = F.col("n_nationkey")
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), k).alias("code"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.when(k >= 5, F.concat(F.lit("n"), k % 5)).alias("aggregate_parent"))
    return verdict.edges(n)


# Normalisation --------------------------------------------------------------------------------------------------------
@_query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'housing' WHEN 1 THEN 'finance,welfare' WHEN 2 THEN 'other,employment' WHEN 3 THEN '' WHEN 4 THEN 'startup,education' ELSE 'welfare' END AS categories, p_partkey % 6 = 2 AS unmapped,
  CASE p_partkey % 5 WHEN 0 THEN '서울특별시' WHEN 1 THEN '' WHEN 2 THEN '경기도,수원시' WHEN 3 THEN '부산광역시' ELSE '' END AS regions, CASE p_partkey % 5 WHEN 1 THEN 'unmapped_region_code' WHEN 3 THEN 'unmapped_region' END AS region_issue,
  CASE p_partkey % 4 WHEN 0 THEN 'nationwide' WHEN 1 THEN 'regional' ELSE 'unknown' END AS scope, CASE WHEN p_partkey % 4 = 1 THEN '11110,26110' ELSE '' END AS codes FROM part""")
def normalized_values(spark, d):
    """Category words, region words and code lists written out and read again."""
    pick = lambda n, *vs: F.element_at(F.array(*[F.lit(v) for v in vs]), (F.col("p_partkey") % n + 1).cast("int"))
    rows = table(spark, d, "part").select("p_partkey", pick(6, "주거", "금융·복지·문화", "뭔가,일자리", None, "창업, 교육 ,창업", "복지･문화").alias("c"), pick(5, "서울", "11110, 26110", "경기/수원시|경기", "부산시,어디", None).alias("r"), pick(4, " 전국 ", "11110,26110", "1111", None).alias("e"))
    rows = rows.select("p_partkey", normalize.categories(F.col("c")).alias("c"), normalize.region_names(F.col("r")).alias("r"), normalize.code_evidence(F.col("e")).alias("e"))
    return rows.select("p_partkey", F.array_join("c.categories", ",").alias("categories"), "c.unmapped", F.array_join("r.regions", ",").alias("regions"), F.col("r.issue").alias("region_issue"), "e.scope", F.array_join("e.codes", ",").alias("codes"))


_AVAIL = {0: ("application_period_missing", "review_required"), 1: ("application_explicitly_closed", "closed"), 2: ("application_always_open", "open"), 3: ("application_open_until_budget", "open"), 4: ("budget_exhaustion_state_unknown", "review_required"), 7: ("application_period_invalid", "review_required"), 9: ("application_explicitly_open", "open"), 10: ("application_period_unresolved", "review_required")}


@_query(f"""WITH o AS (SELECT o_orderkey AS k, o_orderkey % 11 AS w, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + 45 AS e FROM orders), b AS (SELECT *, CASE w WHEN 8 THEN date_trunc('month', s)::DATE ELSE s END AS lo, CASE w WHEN 8 THEN last_day(e) ELSE e END AS hi, DATE '{TODAY}' AS t FROM o)
SELECT k, CASE w {' '.join(f"WHEN {i} THEN '{s}'" for i, (_, s) in _AVAIL.items())} WHEN 6 THEN CASE WHEN t > s THEN 'closed' ELSE 'open' END ELSE CASE WHEN t < lo THEN 'scheduled' WHEN t > hi THEN 'closed' ELSE 'open' END END AS state,
  CASE w {' '.join(f"WHEN {i} THEN '{r}'" for i, (r, _) in _AVAIL.items())} WHEN 6 THEN CASE WHEN t > s THEN 'application_period_ended' ELSE 'application_period_open' END ELSE CASE WHEN t < lo THEN 'application_not_started' WHEN t > hi THEN 'application_period_ended' ELSE 'application_period_open' END END AS reason FROM b""")
def regional_availability(spark, d):
    """Application periods in eleven ways, as two kinds of sources read them."""
    s, k = periods.day(F.col("o_orderdate")), F.col("o_orderkey") % 11
    e = F.date_add(s, 45)
    dot, flat, word, month = (lambda c: F.date_format(c, "yyyy.MM.dd")), (lambda c: F.date_format(c, "yyyyMMdd")), (lambda c: F.date_format(c, "yyyy년 M월 d일")), (lambda c: F.date_format(c, "yyyy년 M월"))
    ways = [F.lit(None).cast("string"), F.lit("접수 종료"), F.lit("상시"), F.lit("예산 소진까지 접수중"), F.lit("예산  소진 시"), F.concat_ws(" ~ ", dot(s), dot(e)), F.concat(word(s), F.lit("까지")), F.concat_ws("~", flat(e), flat(s)), F.concat_ws("~", month(s), month(e)), F.lit("신청 가능"), F.lit("추후 공지")]
    said = F.element_at(F.array(*ways), (k + 1).cast("int"))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), said.alias("text"))
    return parsing.each_once(rows, "text", "a", lambda c: normalize.availability(c, F.lit(TODAY).cast("date"))).select("k", "a.state", "a.reason")


@_query("""WITH o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) + 7305 AS s, CAST(o_orderdate AS DATE) + 7350 AS e, DATE '2016-06-15' AS t FROM orders)
SELECT k, CASE k % 6 WHEN 0 THEN CASE WHEN t BETWEEN s AND e THEN 'open' WHEN t > e THEN 'closed' ELSE 'unknown' END WHEN 1 THEN CASE WHEN t BETWEEN s AND e OR t BETWEEN s + 400 AND e + 400 THEN 'open' WHEN t > e + 400 THEN 'closed' ELSE 'unknown' END WHEN 2 THEN 'closed' WHEN 3 THEN 'open' ELSE 'unknown' END AS availability FROM o""")
def supplemental_availability(spark, d):
    """Date ranges, one or two of them, and words, as supplemental sources write them."""
    s, k = F.date_add(periods.day(F.col("o_orderdate")), 7305), F.col("o_orderkey")
    dot = lambda n: F.date_format(F.date_add(s, n), "yyyy. M. d")
    once = F.concat_ws(" 09:00 ~ ", dot(0), dot(45))
    twice = F.concat_ws(" | ", once, F.concat_ws("~", F.date_format(F.date_add(s, 400), "yyyy-MM-dd"), F.date_format(F.date_add(s, 445), "yyyy/MM/dd")))
    ways = F.array(once, twice, F.lit("신청불가"), F.lit("수시 접수"), F.concat_ws("~", dot(45), dot(0)), F.lit(None).cast("string"))
    said = F.element_at(ways, (k % 6 + 1).cast("int"))
    return table(spark, d, "orders").select(k.alias("k"), normalize.supplemental_availability(said, F.lit("2016-06-15").cast("date")).alias("availability"))


@_query(f"""WITH {_P}, c AS (SELECT *, collected_at AS t, application_start IS NULL AND application_end IS NULL AS none FROM p)
SELECT id, CASE WHEN period_text IS NULL AND none AND schedule IS NULL AND status IS NULL THEN true WHEN period_text IS NULL OR coalesce(application_start > application_end, false) THEN false WHEN schedule = 'always' THEN none AND coalesce(status = 'open', false)
  WHEN schedule = 'until_budget_exhausted' THEN none AND status IS NULL WHEN schedule = 'fixed_period' THEN CASE WHEN none THEN status IS NULL WHEN application_start IS NULL THEN false WHEN application_end IS NULL THEN status IS NOT DISTINCT FROM CASE WHEN t < application_start THEN 'scheduled' END
    ELSE status IS NOT DISTINCT FROM CASE WHEN t < application_start THEN 'scheduled' WHEN t > application_end THEN 'closed' ELSE 'open' END END WHEN status = 'closed' THEN contains(period_text, '마감') AND none ELSE status IS NULL AND none END AS consistent FROM c""")
def period_consistency(spark, d):
    p = policies(spark, d)
    return p.select("id", normalize.period_consistent(*[F.col(c) for c in ("period_text", "application_start", "application_end", "schedule", "status", "collected_at")]).alias("consistent"))


@_query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '연령 제한 없음' WHEN 1 THEN '19세 ~ 34세' WHEN 2 THEN '19세 이상' ELSE '34세 이하' END AS age_text, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'a' || chr(10) || 'b' ELSE c_name END AS cleaned,
  CASE WHEN c_custkey % 3 = 0 THEN '02-120' WHEN c_custkey % 3 = 1 THEN NULL ELSE 'desk ' || c_custkey END AS contact, lower(replace(replace(c_name, '#', ''), ' ', '')) AS title_key,
  CASE WHEN c_custkey % 5 IN (0, 1) THEN 'https://www.example.go.kr/a?seq=' || c_custkey END AS url, CASE WHEN c_custkey % 5 IN (0, 1) THEN 'seq:' || c_custkey WHEN c_custkey % 5 = 2 THEN 'plcyNo:' || c_custkey END AS identity FROM customer""")
def source_fields(spark, d):
    """Single fields of sources: ages, blank texts, contacts, title keys, safe addresses and the identity in them."""
    k, n = F.col("c_custkey"), F.col("c_custkey").cast("string")
    pick = lambda m, *vs: F.element_at(F.array(*[v if not isinstance(v, str | None) else F.lit(v) for v in vs]), (k % m + 1).cast("int"))
    raw = pick(4, " -- ", "a\r\nb ", F.concat(F.lit(" "), "c_name"), F.col("c_name"))
    contact = pick(3, "02-120 / 담당자", "a.b@x.kr 010-1234-5678", F.concat(F.lit("desk "), n, F.lit(" | 010 1234 5678")))
    plain = F.concat(F.lit("https://www.example.go.kr/a?seq="), n)
    url = pick(5, plain, plain, F.concat(F.lit("https://u:p@x.kr/ythPlcyDetail/"), n), F.concat(plain, F.lit("&token=abc")), "ftp://x.kr/a")
    url = F.when(k % 5 == 3, F.concat(F.lit("https://x.kr/a?token="), n)).otherwise(url)
    age = normalize.age_text(pick(4, "N", "Y", "Y", "Y"), pick(4, "", "19", "19", None), pick(4, "", "34", " ", "34"))
    return table(spark, d, "customer").select("c_custkey", age.alias("age_text"), normalize.source_text(raw).alias("cleaned"), normalize.public_contact(contact).alias("contact"), normalize.title_key(F.col("c_name")).alias("title_key"), normalize.safe_url(url).alias("url"), normalize.url_identity(url).alias("identity"))


@_query("""SELECT CAST(count(*) FILTER (WHERE o_orderkey % 4 = 0) AS BIGINT) AS high_risk, CAST(count(*) FILTER (WHERE o_orderkey % 4 = 1) AS BIGINT) AS navigation_tokens, CAST(count(*) FILTER (WHERE o_orderkey % 4 = 2) AS BIGINT) AS unsafe_tokens FROM orders""")
def url_risk_counts(spark, d):
    n = F.col("o_orderkey").cast("string")
    k = F.col("o_orderkey") % 4
    url = F.when(k == 0, F.concat(F.lit("https://x.kr/?serviceKey="), n)).when(k == 1, F.concat(F.lit("https://a.go.kr/?token="), n)).when(k == 2, F.concat(F.lit("https://x.kr/?token="), n)).otherwise(F.concat(F.lit("https://x.kr/?page="), n))
    return normalize.url_risks(table(spark, d, "orders").select(url.alias("url")), ("servicekey",))


# Validation -----------------------------------------------------------------------------------------------------------
_ISSUES = f"""list_filter([CASE WHEN external_id IS NULL THEN '$.external_id|required|error' END, CASE WHEN age_min > 150 THEN '$.age_min|maximum|error' END, CASE WHEN application_start > application_end THEN '$.application_end|date_order|error' END, CASE WHEN age_min > age_max THEN '$.age_max|age_order|error' END,
  CASE WHEN scope = 'regional' AND id % 7 = 6 THEN '$.coverage_scope|regional_without_include|error' END, CASE WHEN scope = 'unknown' AND id % 14 = 0 THEN '$.coverage_scope|unknown_with_matched_region|error' END, CASE WHEN scope = 'nationwide' AND id % 14 = 1 THEN '$.region_rules|nationwide_region_rules|error' END,
  CASE WHEN id % 7 = 3 AND id % 2 = 0 THEN '$.region_rules|region_include_exclude_conflict|error' END], lambda x: x IS NOT NULL)"""
_GAPS = """list_filter([CASE WHEN cats = '' THEN '$.categories|missing_categories|warning' END, CASE WHEN regs = '' THEN '$.regions|missing_regions|warning' END, CASE WHEN age_text IS NULL THEN '$.age_condition_text|missing_age_condition|warning' END,
  CASE WHEN age_min IS NULL AND age_max IS NULL AND NOT contains(age_text, '제한 없음') THEN '$.age_condition_text|unstructured_age_condition|warning' END, CASE WHEN period_text IS NULL AND application_start IS NULL AND schedule IS NULL AND status IS NULL THEN '$.application_period_text|missing_application_period|warning' END], lambda x: x IS NOT NULL)"""


@_query(f"""WITH {_P}, e AS (SELECT id, {_ISSUES} AS i, {_GAPS} AS g FROM p) SELECT id, array_to_string(CASE WHEN len(i) > 0 THEN list_sort(i) ELSE list_sort(g) END, ',') AS issues, CASE WHEN len(i) > 0 THEN 'invalid' WHEN len(g) > 0 THEN 'partial' ELSE 'valid' END AS class FROM e""")
def program_validation(spark, d):
    """Contract, semantic and region rules and gaps of every program, and its class."""
    k = F.col("id")
    rule = lambda relation, code: F.struct(F.lit(relation).alias("relation"), F.lit("matched").alias("resolution"), F.lit("s").alias("scheme"), code.alias("code"), F.lit(None).cast("string").alias("source_code"), F.lit("t").alias("source_text"))
    some = F.when((k % 7 == 1) & (k % 14 == 1) | (k % 14 == 0), F.array(rule("include", F.lit("r1")))).when(k % 7 == 6, F.array(rule("exclude", F.lit("r1")))).when((k % 7 == 3) & (k % 2 == 0), F.array(rule("include", F.lit("r1")), rule("exclude", F.lit("r1"))))
    rules = some.when((k % 7).isin(0, 1), F.filter(F.array(rule("include", F.lit("r1"))), lambda x: F.lit(False))).otherwise(F.array(rule("include", F.lit("r1")), rule("include", F.lit("n1"))))
    out = validate.validated(policies(spark, d).withColumn("rules", rules), ("external_id", "title"), "rules")
    return out.select("id", F.array_join(F.array_sort("issues"), ",").alias("issues"), "class")


# Decisions ------------------------------------------------------------------------------------------------------------
@_query("""WITH m AS (SELECT doc_id, lower(regexp_replace(coalesce(text, ''), '[^\\p{L}\\p{N}]', '', 'g')) AS k FROM documents) SELECT doc_id, concat_ws('+', CASE WHEN contains(k, 'allrightsreserved') THEN 'law/All rights reserved' END, CASE WHEN contains(k, 'contact') THEN 'mail/contact' END, CASE WHEN contains(k, 'password') THEN 'secret/password' END) AS groups FROM m""")
def marker_taxonomy(spark, d):
    """Marker groups of texts by comparison keys."""
    key = F.lower(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\p{L}\p{N}]", ""))
    return table(spark, d, "documents").select("doc_id", F.array_join(decide.taxonomy(key, {"secret": ("password",), "mail": ("contact",), "law": ("All rights reserved",)}), "+").alias("groups"))


@_query("""WITH k AS (SELECT o_orderkey AS id, o_orderkey % 16 AS c FROM orders) SELECT id, CASE WHEN c IN (0, 10, 12) THEN 'exclude_invalid' WHEN c = 1 THEN 'exclude_failed' WHEN c = 2 THEN 'exclude_closed' WHEN c IN (3, 13) THEN 'exclude_duplicate' WHEN c = 15 THEN 'promote_partial' ELSE 'hold_review' END AS outcome,
  ['invalid_identity_url_or_provenance', 'checkpoint_failed', 'application_closed', 'checkpoint_duplicate', 'checkpoint_not_review', 'youth_target_unconfirmed', 'regional_evidence_not_admissible', 'regional_evidence_not_admissible', 'current_application_unconfirmed', 'current_application_unconfirmed', 'normalized_program_invalid', 'normalization_contract_not_satisfied', 'policy_fingerprint_missing', 'duplicate_confirmed', 'duplicate_review_required', 'all_admission_conditions_satisfied'][c + 1] AS reason FROM k""")
def review_admission(spark, d):
    """Each case of the admission order; what comes later is set so that it would decide otherwise."""
    k = (F.col("o_orderkey") % 16).cast("int")
    at = lambda case, value, other: F.when(k == case, value).otherwise(other)
    none = F.array().cast("array<string>")
    good = F.array(F.lit("source_region_confirmed"), F.lit("application_period_open"))
    rows = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"),
        (k != 0).alias("identity_valid"),
        F.when(k == 1, "failed").when(k == 3, "duplicate").when(k == 4, "pending").when(k == 0, "failed").otherwise("review").alias("checkpoint"),
        F.when(k.isin(2, 1), "closed").when(k == 8, "scheduled").otherwise("open").alias("application"),
        F.when(k == 5, none).otherwise(F.array(F.lit("청년"))).alias("markers"),
        good.alias("original"),
        F.when(k == 6, F.array(F.lit("region_conflict"), F.lit("source_region_confirmed"), F.lit("application_period_open"))).when(k == 7, F.array(F.lit("application_period_open"))).when(k == 9, F.array(F.lit("source_region_confirmed"))).otherwise(none).alias("current"),
        F.when(k == 10, "invalid").when(k == 11, "skipped").when(k % 2 == 0, "valid").otherwise("partial").alias("normalization"),
        at(12, F.lit(None).cast("string"), F.lit("sha256:x")).alias("fingerprint"),
        F.when(k.isin(13, 0), "excluded_aggregator_duplicate").when(k == 14, "duplicate_review_required").otherwise("accepted_regional").alias("duplicate"),
    )
    outcome, reason = decide.admission()
    return rows.select("id", outcome.alias("outcome"), reason.alias("reason"))


_STEPS = ["excluded_aggregator_duplicate/aggregator_external_id_match", "excluded_aggregator_duplicate/canonical_url_match", "duplicate_review_required/canonical_url_matches_multiple_policies", "excluded_aggregator_duplicate/official_announcement_id_match", "duplicate_review_required/full_fingerprint_match_requires_review", "duplicate_review_required/same_title_with_incomplete_comparison_evidence", "accepted_regional/same_title_but_material_fields_differ", "duplicate_review_required/material_title_containment_requires_review", "accepted_regional/no_cross_source_candidate"]


@_query(f"""WITH s AS (SELECT p_partkey AS id, [{', '.join(f"'{x}'" for x in _STEPS)}][p_partkey % 9 + 1] AS k FROM part) SELECT id, split_part(k, '/', 1) AS outcome, split_part(k, '/', 2) AS reason, CAST(CASE id % 9 WHEN 2 THEN 2 WHEN 8 THEN 0 ELSE 1 END AS BIGINT) AS matches FROM s""")
def duplicate_steps(spark, d):
    """Each step of the duplicate decision, for candidates and a baseline written out so that just that step has an answer."""
    k, n = (F.col("p_partkey") % 9).cast("int"), F.lpad(F.col("p_partkey").cast("string"), 8, "0")
    none = F.array().cast("array<string>")
    p = table(spark, d, "part")
    key = lambda tag: F.concat(F.lit(tag), n)
    base = p.where(k != 8).select(
        key("b").alias("id"),
        F.when(k.isin(4, 5, 6), key("title")).when(k == 7, F.concat(key("inner"), F.lit("longer"))).otherwise(key("other")).alias("title_key"),
        F.when(k == 5, "").otherwise("org").alias("org_key"),
        F.when(k == 6, "another").otherwise("help").alias("support_key"),
        F.array(F.lit("s:r1")).alias("region_keys"),
        F.lit("1996-01-01").cast("date").alias("application_start"),
        F.lit("1996-02-01").cast("date").alias("application_end"),
        F.when(k.isin(1, 2), F.array(key("http://x/"))).otherwise(none).alias("urls"),
        F.when(k == 3, F.array(key("notice"))).otherwise(none).alias("announcements"),
    )
    twin = p.where(k == 2).select(key("c").alias("id"), key("third").alias("title_key"), F.lit("org").alias("org_key"), F.lit("help").alias("support_key"), F.array(F.lit("s:r1")).alias("region_keys"), F.lit("1996-01-01").cast("date").alias("application_start"), F.lit("1996-02-01").cast("date").alias("application_end"), F.array(key("http://x/")).alias("urls"), none.alias("announcements"))
    mine = p.select(
        F.col("p_partkey").alias("id"),
        F.when(k == 7, key("inner")).when(k == 8, key("lone")).otherwise(key("title")).alias("title_key"),
        F.lit("org").alias("org_key"),
        F.lit("help").alias("support_key"),
        F.array(F.lit("s:r1")).alias("region_keys"),
        F.lit("1996-01-01").cast("date").alias("application_start"),
        F.lit("1996-02-01").cast("date").alias("application_end"),
        F.when(k.isin(1, 2), F.array(key("http://x/"))).otherwise(none).alias("urls"),
        F.when(k == 3, F.array(key("notice"))).otherwise(none).alias("announcements"),
        F.when(k == 0, F.array(key("b"))).otherwise(none).alias("references"),
    )
    return decide.duplicate_decisions(mine, base.unionByName(twin))


@_query("""WITH n AS (SELECT p_partkey AS id, lower(regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g')) || p_partkey % 50 AS k FROM part) SELECT DISTINCT a.k AS a, b.k AS b FROM (SELECT DISTINCT k FROM n) a, (SELECT DISTINCT k FROM n) b
WHERE a.k <> b.k AND least(length(a.k), length(b.k)) >= 5 AND (contains(a.k, b.k) OR contains(b.k, a.k))""")
def title_containment(spark, d):
    """Pairs of titles of which one is part of the other, by an equi-join on their parts."""
    key = F.concat(F.lower(F.regexp_replace("p_name", "[^A-Za-z0-9]", "")), F.col("p_partkey") % 50)
    keys = table(spark, d, "part").select(key.alias("key")).distinct().select(F.col("key").alias("id"), "key")
    return decide.contained_titles(keys, keys)


@_query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey WHEN s_suppkey % 4 = 1 THEN s_suppkey - 1 WHEN s_suppkey % 4 = 2 THEN s_suppkey - 2 END AS match, CASE s_suppkey % 4 WHEN 0 THEN 'id' WHEN 1 THEN 'url' WHEN 2 THEN 'title' END AS via FROM supplier""")
def alternative_lookup(spark, d):
    k = F.col("s_suppkey")
    base = table(spark, d, "supplier").where("s_suppkey % 4 = 0").select(k.alias("id"), F.concat(F.lit("x"), k).alias("external"), F.concat(F.lit("u"), k).alias("url"), F.concat(F.lit("t"), k).alias("title"))
    mine = table(spark, d, "supplier").select(k.alias("id"), F.when(k % 4 == 0, F.concat(F.lit("x"), k)).alias("external"), F.when(k % 4 == 1, F.concat(F.lit("u"), k - 1)).alias("url"), F.when(k % 4 == 2, F.concat(F.lit("t"), k - 2)).alias("title"))
    return decide.alternative_match(mine, base)


_GATE = {0: ("non_regional", "nationwide_republication"), 1: ("non_regional", "other_region_policy"), 2: ("regional_confirmed", "source_region_confirmed+target_region_confirmed+implementing_region_confirmed"), 3: ("regional_confirmed", "source_scope_region_confirmed+source_scope_operator_confirmed+implementing_region_confirmed"), 4: ("regional_review_required", "insufficient_regional_evidence")}


@_query(f"""WITH k AS (SELECT c_custkey AS id, c_custkey % 5 AS g, c_custkey % 3 AS a, c_custkey % 2 AS y, c_custkey % 7 = 0 AS dup FROM customer), s AS (SELECT *, CASE g {' '.join(f"WHEN {i} THEN '{s}'" for i, (s, _) in _GATE.items())} END AS state, CASE g {' '.join(f"WHEN {i} THEN '{r}'" for i, (_, r) in _GATE.items())} END AS reasons FROM k)
SELECT id, state, reasons, CASE WHEN y = 0 THEN 'youth_target_confirmed' WHEN a = 0 THEN 'youth_target_confirmed_by_scope_and_age' ELSE 'youth_target_unconfirmed' END AS youth,
  CASE WHEN a = 2 THEN 'closed' WHEN state <> 'regional_confirmed' OR a = 1 OR (y = 1 AND a <> 0) THEN 'review' WHEN dup THEN 'duplicate' ELSE 'accepted' END AS outcome FROM s""")
def regional_gate(spark, d):
    """Regionality, youth target and the outcome that follows with availability and duplicates."""
    k = F.col("c_custkey")
    g, a = (k % 5).cast("int"), (k % 3).cast("int")
    rows = table(spark, d, "customer").select(
        k.alias("id"),
        F.when(g == 0, "전국").when(g == 1, "부산").when(g == 2, "수원시").alias("source_region"),
        F.when(g == 2, "수원 청년").otherwise("주민").alias("eligibility"),
        F.when(g.isin(2, 3), "수원시청").otherwise("기관").alias("organization"),
        F.when(g == 3, "수원").alias("jurisdiction"),
        F.when(g == 3, "수원재단").alias("operator"),
        F.when(k % 2 == 0, "청년 지원").otherwise("지원").alias("title"),
        F.when(a == 0, "만 19세").otherwise("19").alias("age"),
        F.when(a == 0, "open").when(a == 1, "scheduled").otherwise("closed").alias("application"),
        F.when(k % 7 == 0, False).when(k % 11 == 0, F.lit(None).cast("boolean")).otherwise(True).alias("fresh"),
        F.when(g == 1, "26").when(g == 2, "41").alias("code"),
    )
    state = decide.regionality(F.array(F.lit("수원"), F.lit("수원시")), F.col("code"), F.array(F.lit("41")))
    rows = rows.withColumn("r", state).withColumn("youth", decide.youth_target([F.col("title")], F.col("age"), F.lit("청년정책")))
    ok = decide.accepted(F.col("r.state"), F.col("application"), F.col("youth"))
    return rows.select("id", "r.state", "r.reasons", "youth", decide.outcome(F.col("application"), ok, F.col("fresh")).alias("outcome"))


# Gates ----------------------------------------------------------------------------------------------------------------
@_query("""SELECT DISTINCT key, blocker FROM (SELECT n_nationkey AS key, unnest(CASE n_nationkey % 5 WHEN 1 THEN ['total_changed'] WHEN 2 THEN ['item_repeated', 'fewer_items_than_total'] WHEN 3 THEN ['fewer_items_than_total', 'page_missing'] WHEN 4 THEN ['budget_exceeded'] ELSE [] END) AS blocker FROM nation)""")
def snapshot_proof(spark, d):
    """Sources whose pages don't prove a complete snapshot, and why."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("source"))
    k = F.col("source") % 5
    pages = n.select("source", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("page"), F.lit(4).alias("page_size"))
    pages = pages.withColumns({"total": F.when((k == 1) & (F.col("page") == 3), 99).otherwise(10), "requests": F.when(k == 4, 9).otherwise(1)}).where(~((k == 3) & (F.col("page") == 2)))
    pages = pages.withColumn("total", F.when((k == 1) & (F.col("page") == 3), 9).otherwise(F.col("total")))
    items = pages.select("source", "page", F.explode(F.expr("sequence(1, CASE WHEN page = 3 THEN 2 ELSE 4 END)")).alias("i"))
    same = F.when((k == 2) & (F.col("page") == 3), F.col("i")).otherwise(F.col("page") * 10 + F.col("i"))
    items = items.select("source", "page", F.when((k == 2) & (F.col("page") == 3), F.col("i") + 10).otherwise(same).alias("id"))
    return gates.snapshot_blockers(pages, items, 10)


@_query("""WITH o AS (SELECT o_custkey AS s, o_orderkey AS run, o_orderstatus AS st, o_totalprice > 400000 AS failed, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders), c AS (SELECT * FROM o WHERE r = CASE WHEN s % 10 = 0 THEN 2 ELSE 1 END),
b AS (SELECT CAST(s AS VARCHAR) AS key, unnest(list_filter([CASE WHEN r <> 1 THEN 'not_latest' END, CASE WHEN st = 'P' THEN 'not_succeeded' END, CASE WHEN st = 'P' THEN 'not_complete' END, CASE WHEN failed THEN 'has_failures' END], lambda x: x IS NOT NULL)) AS blocker FROM c)
SELECT key, blocker FROM b UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'no_run' FROM customer WHERE c_custkey NOT IN (SELECT s FROM c)""")
def promotion_gate(spark, d):
    """What keeps sources from being promoted with the runs that were chosen for them."""
    runs = table(spark, d, "orders").select(F.col("o_orderkey").alias("run"), F.col("o_custkey").cast("string").alias("source"), F.lit("collection").alias("type"), F.when(F.col("o_orderstatus") == "P", "failed").otherwise("succeeded").alias("status"), F.col("o_orderdate").alias("started"), F.col("o_orderdate").alias("finished"), (F.col("o_orderstatus") != "P").alias("complete"), (F.col("o_totalprice") > 400000).cast("int").alias("failures"))
    second = audit.first_of_each(runs, ["source"], [F.col("started").desc(), F.col("run").desc()], 2)
    chosen = second.where(F.col("place") == F.when(F.col("source").cast("long") % 10 == 0, 2).otherwise(1)).select("run")
    return gates.promotion_blockers(runs, chosen, table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("source")))


@_query("""SELECT n_nationkey AS key, CASE n_nationkey % 3 WHEN 0 THEN 'insert' WHEN 1 THEN 'changed' END AS change FROM nation WHERE n_nationkey % 3 < 2 UNION ALL SELECT 100 + r_regionkey, 'unexpected' FROM region""")
def reference_import(spark, d):
    """An insert-only import: what is new, and what it must refuse."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("v"))
    old = n.where("key % 3 <> 0").withColumn("v", F.when(F.col("key") % 3 == 1, "old").otherwise(F.col("v")))
    extra = table(spark, d, "region").select((F.col("r_regionkey") + 100).alias("key"), F.col("r_name").alias("v"))
    return gates.reference_changes(old.unionByName(extra), n, ["key"], ["v"])


@_query("SELECT c_custkey AS policy FROM customer WHERE c_custkey % 3 <> 0")
def changed_rules(spark, d):
    """Policies whose multiset of rules is another than before."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("policy"), F.explode(F.array(F.lit("a"), F.lit("a"), F.lit("b"))).alias("code"))
    new = c.where(~((F.col("policy") % 3 == 1) & (F.col("code") == "b"))).unionByName(c.where("policy % 3 = 2 AND code = 'b'"))
    return gates.changed_children(c, new, "policy", ["code"])


@_query("""SELECT o_orderkey AS run, CASE o_orderkey % 4 WHEN 0 THEN 'succeeded' WHEN 1 THEN 'running' WHEN 2 THEN 'failed' ELSE 'succeeded' END AS state, o_orderkey % 4 <> 3 AS allowed FROM orders""")
def run_states(spark, d):
    """States of runs from their logged steps, and whether each step was allowed."""
    k = F.col("o_orderkey") % 4
    steps = F.when(k == 0, "enqueue,claim,succeed").when(k == 1, "start").when(k == 2, "start,fail").otherwise("enqueue,succeed")
    return gates.run_log(table(spark, d, "orders").select(F.col("o_orderkey").alias("run"), F.posexplode(F.split(steps, ",")).alias("seq", "step")))


@_query(f"""SELECT event_id, epoch(date_trunc('second', TIMESTAMP '2024-02-01') - date_trunc('second', ts))::BIGINT AS seconds, event_type IN ('click', 'view') AND event_id % 3 <> 0 AND epoch(date_trunc('second', TIMESTAMP '2024-02-01') - date_trunc('second', ts)) >= 7200 AS stale FROM events""")
def stale_runs(spark, d):
    """Runs that neither ended nor moved for two hours."""
    e, now = table(spark, d, "events"), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    status = F.when(F.col("event_type") == "click", "queued").when(F.col("event_type") == "view", "running").otherwise("done")
    return e.select("event_id", gates.elapsed(F.col("ts"), now).alias("seconds"), gates.stale(status, F.col("ts"), F.when(F.col("event_id") % 3 == 0, F.col("ts")), now).alias("stale"))


# Display --------------------------------------------------------------------------------------------------------------
_KIND = f"CASE WHEN status = 'closed' THEN 'closed' WHEN schedule = 'always' AND status = 'open' AND application_end IS NULL THEN 'always' WHEN application_end IS NULL THEN 'unknown' WHEN application_end > DATE '{TODAY}' THEN 'upcoming' WHEN application_end = DATE '{TODAY}' THEN 'today' ELSE 'past' END"


@_query(f"""WITH {_P}, k AS (SELECT *, {_KIND} AS kind, date_diff('day', DATE '{TODAY}', application_end) AS n FROM p), s AS (SELECT *, coalesce(kind IN ('upcoming', 'today') AND n BETWEEN 0 AND 7, false) AS soon FROM k)
SELECT id, kind, CASE WHEN kind IN ('closed', 'past') THEN '마감' WHEN kind = 'always' THEN '상시' WHEN kind = 'unknown' THEN '일정 미정' WHEN kind = 'today' THEN 'D-Day' ELSE 'D-' || n END AS label, soon, coalesce(status = 'open', false) AND kind NOT IN ('closed', 'past') AS featured,
  CASE WHEN schedule = 'always' AND status = 'open' THEN '상시' WHEN quality = 'partial' THEN '정보 미확인' WHEN soon THEN '마감임박' WHEN status = 'open' THEN '모집중' WHEN status = 'scheduled' THEN '예정' WHEN status = 'closed' THEN '마감' WHEN schedule = 'always' THEN '상시' WHEN schedule = 'fixed_period' THEN '기간 모집' WHEN schedule IS NOT NULL THEN '예산 소진 시' ELSE '정책' END AS badge FROM s""")
def deadline_badges(spark, d):
    p, today = policies(spark, d), F.lit(TODAY).cast("date")
    st, sc, q, end = (F.col(c) for c in ("status", "schedule", "quality", "application_end"))
    p = p.withColumn("kind", display.deadline(st, sc, end, today)).withColumn("soon", display.imminent(F.col("kind"), end, today))
    return p.select("id", "kind", display.deadline_label(F.col("kind"), end, today).alias("label"), "soon", display.featured(F.col("kind"), st).alias("featured"), display.badge(st, sc, q, F.col("soon")).alias("badge"))


@_query(f"""WITH {_P}, k AS (SELECT *, strftime(application_start, '%Y.%m.%d') AS a, strftime(application_end, '%Y.%m.%d') AS b, {_REGS} AS rl, {_CATS} AS cl FROM p)
SELECT id, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a || ' ~ ' || b WHEN b IS NOT NULL THEN b || ' 마감' WHEN a IS NOT NULL THEN a || ' 시작' WHEN schedule = 'always' THEN '상시' WHEN period_text IS NOT NULL THEN period_text ELSE '기간 미정' END AS period,
  CASE WHEN age_min = 0 AND age_max = 0 THEN '연령 정보 없음' WHEN age_min IS NOT NULL AND age_max IS NOT NULL THEN age_min || '세 ~ ' || age_max || '세' WHEN age_min IS NOT NULL THEN age_min || '세 이상' WHEN age_max IS NOT NULL THEN age_max || '세 이하' ELSE coalesce(age_text, '연령 정보 없음') END AS age,
  CASE WHEN len(rl) = 0 THEN '지역 미정' WHEN len(rl) <= 2 THEN array_to_string(rl, ', ') ELSE array_to_string(rl[1:2], ', ') || ' 외 ' || (len(rl) - 2) || '곳' END AS region,
  CASE WHEN len(cl) = 0 THEN 'other' WHEN cl = ['finance', 'welfare'] THEN 'welfare,finance' ELSE array_to_string(cl, ',') END AS categories FROM k""")
def display_texts(spark, d):
    c = F.col
    return policies(spark, d).select("id", display.period_card(c("application_start"), c("application_end"), c("schedule"), c("period_text")).alias("period"), display.age_label(c("age_min"), c("age_max"), c("age_text")).alias("age"), display.region_label(c("regions"), F.lit(None).cast("string")).alias("region"), F.array_join(display.category_order(c("categories"), "welfare"), ",").alias("categories"))


@_query(f"""WITH {_P}, k AS (SELECT *, {_REGS} AS rl, {_CATS} AS cl FROM p)
SELECT id, contains(lower(concat_ws(' ', title, organization, support_content, age_text)), 'ring') AND (list_contains(rl, '전국') OR list_contains(rl, 'r1')) AND ((age_min IS NULL AND age_max IS NULL) OR 25 BETWEEN coalesce(age_min, 0) AND coalesce(age_max, 150)) AS client,
  CASE WHEN len(cl) = 0 THEN true ELSE list_contains(cl, 'startup') OR list_contains(cl, 'other') END AS calendar, len(rl) = 0 OR list_contains(rl, '전국') OR list_contains(rl, 'n1') AS admin FROM k""")
def client_filters(spark, d):
    p = policies(spark, d).withColumns({c: F.lit(None).cast("string") for c in ("category_text", "eligibility_text", "region_text")})
    return p.select("id", display.client_filter("Ring ", "r1", age=25).alias("client"), display.calendar_filter(F.col("categories"), ("startup", "other")).alias("calendar"), display.admin_region_filter(F.col("regions"), "n1").alias("admin"))


@_query(f"""WITH {_P}, e AS (SELECT id, 'start' AS kind, application_start AS day, title FROM p WHERE application_start IS NOT NULL UNION SELECT id, 'end', application_end, title FROM p WHERE application_end IS NOT NULL)
SELECT id, kind, day, row_number() OVER (ORDER BY day, kind = 'end', title, id) AS rank FROM e QUALIFY rank <= 60""")
def calendar_order(spark, d):
    """The first sixty calendar entries (a top-k report)."""
    return search.ranked(display.calendar_events(policies(spark, d)), display.event_order(), top=60).select("id", "kind", "day", "rank")


@_query(f"""WITH {_P} SELECT id, CAST(date_diff('day', DATE '{TODAY}', application_end) AS BIGINT) AS days FROM p WHERE id % 3 = 0 AND date_diff('day', DATE '{TODAY}', application_end) BETWEEN 0 AND 7""")
def favourite_alerts(spark, d):
    p = policies(spark, d)
    return display.alerts(p, p.where("id % 3 = 0").select("id").unionByName(p.where("id % 6 = 0").select("id")), F.lit(TODAY).cast("date"))


@_query(f"WITH {_P} SELECT DISTINCT unnest(string_split(regs, ',')) AS option FROM p WHERE regs NOT IN ('', '전국')")
def region_options(spark, d):
    return display.option_list(policies(spark, d), "regions", ("전국",))


@_query("""SELECT n_nationkey AS folder, n_nationkey % 4 = 0 AS pinned, (SELECT count(DISTINCT c_mktsegment) FROM customer WHERE c_nationkey = n_nationkey AND n_nationkey % 5 <> 0) AS n FROM nation""")
def bookmark_folders(spark, d):
    f = table(spark, d, "nation").select(F.col("n_nationkey").alias("folder"), (F.col("n_nationkey") % 4 == 0).alias("pinned"))
    return display.folder_counts(f, table(spark, d, "customer").where("c_nationkey % 5 <> 0").select(F.col("c_nationkey").alias("folder"), F.col("c_mktsegment").alias("id")))


# Audits ---------------------------------------------------------------------------------------------------------------
@_query(f"""WITH {_P} SELECT count(*) FILTER (WHERE age_min IS NOT NULL AND age_max IS NOT NULL) AS both_bounds, count(*) FILTER (WHERE (age_min IS NULL) <> (age_max IS NULL)) AS one_bound, count(*) FILTER (WHERE age_min IS NULL AND age_max IS NULL) AS no_bounds FROM p""")
def age_bounds(spark, d):
    return audit.bounds_histogram(policies(spark, d), "age_min", "age_max")


@_query(f"WITH {_P} SELECT t AS term, count(*) FILTER (WHERE contains(lower(title), t)) AS hits, count(*) FILTER (WHERE contains(lower(title), t) AND coalesce(status <> 'closed', true)) AS visible FROM p, (SELECT unnest(['ring', 'widget', 'none']) AS t) GROUP BY t")
def term_counts(spark, d):
    return audit.term_counts(policies(spark, d), "title", ["ring", "widget", "none"], F.coalesce(F.col("status") != "closed", F.lit(True)))


@_query(f"WITH {_P}, r AS (SELECT id, concat_ws('+', CASE WHEN application_end IS NULL THEN 'no_end' END, CASE WHEN external_id IS NULL THEN 'no_id' END, CASE WHEN status IS NULL THEN 'no_status' END) AS c FROM p) SELECT c AS combination, count(*) AS n FROM r GROUP BY c")
def reason_combinations(spark, d):
    """How often which combination of reasons occurs."""
    return audit.combinations(policies(spark, d), {"no_status": F.col("status").isNull(), "no_end": F.col("application_end").isNull(), "no_id": F.col("external_id").isNull()})


@_query(f"""WITH {_P} SELECT source_id AS source, count(*) FILTER (WHERE status = 'open') AS open, count(*) FILTER (WHERE status = 'closed') AS closed, count(*) FILTER (WHERE status = 'scheduled') AS scheduled, count(*) AS total FROM p GROUP BY source_id""")
def outcome_by_source(spark, d):
    return audit.pivoted(policies(spark, d), "source_id", "status", ("open", "closed", "scheduled")).withColumnRenamed("source_id", "source")


@_query(f"""WITH {_P}, s AS (SELECT id, CASE WHEN title LIKE '%ring%' THEN 'word' WHEN external_id IS NULL THEN 'identity' END AS reason FROM p) SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM s GROUP BY 1""")
def safety_split(spark, d):
    """Rows that are kept and dropped, with the first reason of each that is dropped."""
    kept, dropped = audit.split_by_reason(policies(spark, d), {"word": F.col("title").contains("ring"), "identity": F.col("external_id").isNull()})
    return kept.select(F.lit("kept").alias("reason")).unionByName(dropped.select("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT o_custkey AS key, count(DISTINCT o_orderstatus) AS n FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) > 1")
def identity_conflicts(spark, d):
    return decide.conflicts(table(spark, d, "orders").select(F.col("o_custkey").alias("key"), "o_orderstatus"), "key", "o_orderstatus")


@_query(f"""WITH {_P} SELECT id, CASE WHEN id % 10 = 0 THEN 'exact' WHEN external_id LIKE 'e1%' THEN 'first' WHEN external_id LIKE 'e12%' THEN 'never' WHEN external_id LIKE 'e2%' THEN 'second' ELSE 'default' END AS reason FROM p WHERE external_id IS NOT NULL""")
def exclusion_reasons(spark, d):
    p = policies(spark, d).where("external_id IS NOT NULL").select("id", F.col("external_id").alias("x"))
    exact = p.where("id % 10 = 0").select(F.col("x").alias("id"), F.lit("exact").alias("reason"))
    rows = p.select(F.col("x").alias("id"))
    return decide.exclusion_reason(rows, exact, {"e1": "first", "e12": "never", "e2": "second"}, "default").select(F.substring("id", 2, 20).cast("long").alias("id"), "reason")


@_query("""SELECT o_custkey AS id, coalesce(min_by(o_orderpriority, struct_pack(a := o_orderdate, b := o_orderkey)) FILTER (WHERE o_orderpriority <> '5-LOW'), '') AS first_text, CASE WHEN bool_or(o_orderstatus = 'O') THEN 'open' WHEN bool_or(o_orderstatus = 'F') THEN 'closed' ELSE 'unknown' END AS availability FROM orders GROUP BY o_custkey""")
def merged_details(spark, d):
    """Several detail pages of one policy: the first text that isn't blank, and open if any page says so."""
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("doc"), F.when(F.col("o_orderpriority") == "5-LOW", " ").otherwise(F.col("o_orderpriority")).alias("text"), F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "closed").otherwise("unknown").alias("availability"))
    out = snapshot.merged(rows, "id", ["at", "doc"], ["text"], "availability")
    return out.select("id", F.coalesce("text", F.lit("")).alias("first_text"), "availability")


@_query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'cancelled' WHEN rank = 1 THEN 'active' ELSE 'failed' END AS state FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 7 = 0 ORDER BY o_orderdate DESC, o_orderkey DESC) AS rank FROM orders)""")
def one_active_run(spark, d):
    """Of the active runs of a source the latest stays active, the others fail; ended ones are left alone."""
    runs = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("source"), F.col("o_orderdate").alias("at"), F.when(F.col("o_orderkey") % 7 == 0, "cancelled").otherwise("active").alias("state"))
    return snapshot.keep_latest(runs, "source", [F.col("at").desc(), F.col("o_orderkey").desc()], "state", "active", "failed").select("o_orderkey", "state")


@_query("""WITH nodes AS (SELECT 'n' || n_nationkey AS code, CASE WHEN n_nationkey = 3 THEN 'n8' WHEN n_nationkey = 8 THEN 'n13' WHEN n_nationkey = 13 THEN 'n3' ELSE 'r' || n_regionkey END AS parent FROM nation) SELECT code FROM nodes WHERE code IN ('n3', 'n8', 'n13')""")
def tree_cycles(spark, d):
    """Codes that reach themselves over either parent pointer."""
    k = F.col("n_nationkey")
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), k).alias("code"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.when(k == 3, "n8").when(k == 8, "n13").when(k == 13, "n3").alias("aggregate_parent"))
    return integrity.cycles(verdict.edges(n))
