"""Registered queries of many questions at once, substring postings and regions of a table of queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightweir import policy_queries
from brightweir.catalog_queries import _TREE, _query, _tree
from brightweir.operators import evidence, postings, questions, search, verdict
from brightweir.policy_queries import _CATS, _HI, _LO, _P, _REGS
from brightweir.session import scratch, table

QUESTIONS = """SELECT s_suppkey AS question, CASE s_suppkey % 9 WHEN 0 THEN 'ring' WHEN 1 THEN 'Widget' WHEN 2 THEN 'bolt' WHEN 3 THEN ' economy ' WHEN 4 THEN 'brand#1' WHEN 5 THEN 'ir' WHEN 6 THEN '청년' WHEN 7 THEN '%ed%t' ELSE 'o' END AS t1,
  CASE s_suppkey % 5 WHEN 0 THEN '지원' WHEN 1 THEN 'support' WHEN 2 THEN 'red' WHEN 3 THEN '' END AS t2, CASE WHEN s_suppkey % 13 = 0 THEN 'blue' WHEN s_suppkey % 17 = 0 THEN '지원' END AS keyword,
  CASE s_suppkey % 4 WHEN 1 THEN 'open' WHEN 2 THEN 'scheduled' END AS status, CASE WHEN s_suppkey % 3 <> 0 THEN CAST(16 + s_nationkey AS INT) END AS age, CASE WHEN s_acctbal > 5000 THEN 'housing' WHEN s_acctbal < 0 THEN 'welfare' END AS category,
  CASE WHEN s_suppkey % 7 < 3 THEN 'n' || CAST(s_nationkey AS STRING) WHEN s_suppkey % 7 = 3 THEN 'r' || CAST(s_nationkey % 5 AS STRING) WHEN s_suppkey % 7 = 4 THEN 'nowhere' END AS region, s_acctbal > 2000 AS include_partial,
  CASE WHEN s_suppkey % 6 = 0 THEN 'housing' WHEN s_suppkey % 6 = 1 THEN 'startup' END AS wanted, CASE WHEN s_suppkey % 8 < 4 THEN 20 END AS wanted_age, CASE WHEN s_suppkey % 10 = 0 THEN 'r1' END AS preferred_region FROM {supplier}"""


def asked(spark, d) -> DataFrame:
    rows = spark.sql(QUESTIONS, supplier=table(spark, d, "supplier"))
    return rows.withColumn("terms", F.array_compact(F.array("t1", "t2"))).withColumn("wanted_categories", F.when(F.col("wanted").isNotNull(), F.array("wanted"))).drop("t1", "t2", "wanted")


def labels(spark, d) -> DataFrame:
    """The region tree's intervals, as persisted."""
    return spark.read.parquet(policy_queries._kept(spark, d, "intervals", lambda path: verdict.intervals(_tree(spark, d)).write.parquet(path)))


def _found(spark, d) -> tuple[DataFrame, DataFrame]:
    """What every question finds, with the regions that questions ask for and policies have."""
    rows, own = policy_queries.projection(spark, d), asked(spark, d)
    codes = own.select(F.explode(F.array("region", "preferred_region")).alias("region")).distinct()
    places = rows.select(F.struct("scope", "regions").alias("policy")).distinct()
    rules = places.select("policy", F.explode("policy.regions").alias("code"), F.lit("include").alias("relation"))
    path = scratch(spark, "verdicts")
    verdict.regions(codes.crossJoin(places), places.select("policy", "policy.scope"), rules, labels(spark, d)).select("region", "policy", "verdict", "reason").write.parquet(path)
    return questions.grouped(questions.projected(rows), own, policy_queries.index(spark, d), spark.read.parquet(path))


def _verdict_of(question: str) -> str:
    """SQL of the (region, id) verdicts of the regions that a column asks for."""
    return f"""(SELECT r.region, p.id, CASE WHEN scope = 'nationwide' THEN 'match/nationwide' WHEN scope = 'unknown' THEN 'unknown/policy_unknown' WHEN r.region NOT IN (SELECT code FROM nodes) THEN 'unknown/query_unmapped'
  WHEN min(up.distance) = 0 THEN 'match/exact' WHEN min(up.distance) > 0 THEN 'match/ancestor' WHEN min(dn.distance) > 0 THEN 'match/descendant' WHEN len(any_value(rl)) = 0 THEN 'unknown/unresolved_rule' ELSE 'mismatch/other_region' END AS v
  FROM (SELECT DISTINCT {question} AS region FROM q WHERE {question} IS NOT NULL) r, pl p LEFT JOIN pr ON pr.id = p.id LEFT JOIN closure up ON up.code = r.region AND up.ancestor = pr.code
  LEFT JOIN closure dn ON dn.code = pr.code AND dn.ancestor = r.region AND dn.distance > 0 GROUP BY r.region, p.id, scope)"""


def _age(age: str) -> str:
    return f"CASE WHEN {age} IS NULL THEN NULL WHEN {age} < ({_LO}) OR {age} > ({_HI}) THEN 'mismatch' WHEN ({_LO}) IS NOT NULL OR ({_HI}) IS NOT NULL THEN 'match' WHEN age_text LIKE '%제한 없음%' THEN 'match' ELSE 'unknown' END"


_FIELDS = {"title": "title", "cat": "replace(cats, ',', ' ')", "summary": "coalesce(summary, '')", "age": "coalesce(age_text, '')", "support": "support_content"}
_HITS = ", ".join(f"len(list_filter(folds, lambda x: contains(lower({c}), x) OR contains(replace(lower({c}), ' ', ''), replace(x, ' ', '')))) AS h_{n}" for n, c in _FIELDS.items())
_IS = lambda what, *vs: " + ".join(f"coalesce({v} = '{what}', false)::INT" for v in vs)
_ANSWERS = f"""WITH RECURSIVE {_TREE}, {_P}, qs AS ({QUESTIONS.replace("{supplier}", "supplier")}),
q AS (SELECT *, list_distinct(list_filter([trim(t1), trim(t2), keyword], lambda x: x IS NOT NULL AND x <> '')) AS said, list_filter([trim(t1), trim(t2)], lambda x: x IS NOT NULL AND x <> '') AS any_of FROM qs),
q2 AS (SELECT *, list_filter(said, lambda x: x NOT IN ('청년', '지원') OR coalesce(x = keyword, false)) AS must, [lower(x) FOR x IN said] AS folds FROM q),
pl AS (SELECT *, {_CATS} AS cl, {_REGS} AS rl, concat_ws(' ', title, CASE WHEN cats <> '' THEN replace(cats, ',', ' ') END, summary, age_text, CASE WHEN support_content <> '' THEN support_content END) AS search_text FROM p),
pr AS (SELECT id, unnest(rl) AS code FROM pl), rv AS {_verdict_of("region")}, pv AS {_verdict_of("preferred_region")},
j AS (SELECT q2.* EXCLUDE (status), q2.status AS want, pl.*, {_age("age")} AS av, {_age("wanted_age")} AS lv FROM q2, pl WHERE quality <> 'invalid' AND (include_partial OR quality = 'valid') AND (q2.status IS NOT NULL OR coalesce(pl.status <> 'closed', true))),
k AS (SELECT j.*, split_part(rv.v, '/', 1) AS gv, split_part(rv.v, '/', 2) AS reason, CASE WHEN preferred_region IS NOT NULL THEN coalesce(split_part(pv.v, '/', 1), 'unknown') END AS pref,
  CASE WHEN want IS NULL THEN NULL WHEN status IS NULL THEN 'unknown' WHEN status = want THEN 'match' ELSE 'mismatch' END AS sv, CASE WHEN category IS NULL THEN NULL WHEN len(cl) = 0 THEN 'unknown' WHEN list_contains(cl, category) THEN 'match' ELSE 'mismatch' END AS cv,
  CASE WHEN wanted IS NULL THEN NULL WHEN len(cl) = 0 THEN 'unknown' WHEN list_contains(cl, wanted) THEN 'match' ELSE 'mismatch' END AS wv, {_HITS}
  FROM j LEFT JOIN rv ON rv.region = j.region AND rv.id = j.id LEFT JOIN pv ON pv.region = j.preferred_region AND pv.id = j.id
  WHERE CASE WHEN len(must) > 0 THEN len(list_filter(must, lambda x: search_text ILIKE '%' || x || '%' OR title ILIKE '%' || x || '%' OR coalesce(summary ILIKE '%' || x || '%', false))) = len(must)
    ELSE len(list_filter(any_of, lambda x: search_text ILIKE '%' || x || '%' OR title ILIKE '%' || x || '%' OR coalesce(summary ILIKE '%' || x || '%', false))) > 0 END),
f AS (SELECT *, CAST(1 + {" + ".join(f"2 * (h_{n} > 0)::INT + h_{n}" for n in _FIELDS)} AS DOUBLE) AS score, CAST({_IS("match", "wv", "lv", "pref")} AS INT) AS preference_matches, CAST({_IS("unknown", "wv", "lv", "pref")} AS INT) AS preference_unknowns,
  CAST({_IS("unknown", "sv", "av", "cv", "gv")} AS INT) AS unknown_count, CASE WHEN region IS NULL THEN 0 WHEN gv = 'unknown' THEN 2 WHEN coalesce(gv <> 'match', true) THEN 3 WHEN reason = 'nationwide' THEN 1 ELSE 0 END AS grp,
  CASE status WHEN 'open' THEN 0 WHEN 'scheduled' THEN 1 WHEN 'closed' THEN 3 ELSE 2 END AS srank FROM k
  WHERE coalesce(sv <> 'mismatch', true) AND coalesce(av <> 'mismatch', true) AND coalesce(cv <> 'mismatch', true) AND coalesce(gv <> 'mismatch', true) AND ({" + ".join(f"h_{n}" for n in _FIELDS)} > 0
    OR len(list_filter(said, lambda x: contains(lower(title), lower(x)) OR contains(lower(coalesce(summary, '')), lower(x)))) > 0)),
s AS (SELECT *, CASE WHEN region IS NULL THEN 0 WHEN grp = 0 THEN greatest(len(rl), 1) ELSE 1000000 END AS breadth, CASE WHEN region IS NULL OR grp <> 0 OR reason = 'exact' THEN 0 WHEN reason IN ('ancestor', 'descendant') THEN 1 ELSE 2 END AS relation FROM f),
a AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, preference_matches DESC, preference_unknowns, grp, breadth, relation, unknown_count, srank, id) AS rank FROM s)"""


@_query(f"""{_ANSWERS} SELECT question, id, CAST(rank AS INT) AS rank, score, preference_matches, preference_unknowns, unknown_count, sv AS status_verdict, av AS age_verdict, cv AS category_verdict, gv AS region_verdict, reason AS region_reason FROM a WHERE rank <= 5""")
def golden_questions(spark, d):
    """A question for each supplier, all in one plan; the five best answers of each (a top-k report)."""
    keep = ["score", "preference_matches", "preference_unknowns", "unknown_count", "status_verdict", "age_verdict", "category_verdict", "region_verdict", "region_reason"]
    return questions.best_of(*_found(spark, d), 5).select("question", "id", "rank", *keep)


@_query(f"""{_ANSWERS}, r AS (SELECT question, count(*) AS matches, count(*) FILTER (WHERE unknown_count = 0 AND quality = 'valid' AND coalesce(status = 'open', false)) AS confirmed, count(*) FILTER (WHERE unknown_count > 0) AS unknown, min(id) FILTER (WHERE rank = 1) AS first_id FROM a GROUP BY question)
SELECT q.question, coalesce(matches, 0) AS matches, coalesce(confirmed, 0) AS confirmed, coalesce(unknown, 0) AS unknown, first_id FROM q LEFT JOIN r ON r.question = q.question""")
def golden_report(spark, d):
    """How many policies answer each question, how many without doubt, and the best one."""
    return questions.report(_found(spark, d)[0], asked(spark, d), (F.col("quality") == "valid") & (F.col("has_status") == "open"))


@_query(f"""{_ANSWERS}, w AS (SELECT question, question * 11 % 997 AS expected_id FROM q)
SELECT w.question AS scenario, CAST(rank AS INT) AS rank, CASE WHEN rank IS NULL THEN 'not_found' ELSE concat_ws(',', CASE WHEN rank > 3 THEN 'rank' END, CASE WHEN coalesce(av <> 'match', true) OR coalesce(gv <> 'match', true)
  THEN 'verdict:' || concat_ws('+', CASE WHEN coalesce(av <> 'match', true) THEN 'age' END, CASE WHEN coalesce(gv <> 'match', true) THEN 'region' END) END) END AS blockers
FROM w LEFT JOIN a ON a.question = w.question AND a.id = expected_id AND a.rank <= 20""")
def acceptance_of_search(spark, d):
    """Scenarios that expect a policy among a question's first results, held against the search itself."""
    want = asked(spark, d).select(F.col("question").alias("scenario"), (F.col("question") * 11 % 997).alias("expected_id"), F.lit(3).alias("most_rank"), F.create_map(F.lit("age"), F.lit("match"), F.lit("region"), F.lit("match")).alias("expected"))
    return evidence.acceptance(questions.results(questions.best_of(*_found(spark, d), 20)), want)


@_query(f"""WITH {_P}, u AS (SELECT id, CASE WHEN id % 10 = 0 THEN upper(title) || ' zz' || CAST(id % 7 AS VARCHAR) ELSE title END AS title, summary FROM p WHERE id % 15 <> 5),
n AS (SELECT DISTINCT substr(p_name, 3, 5) AS needle FROM part UNION SELECT 'zz3' UNION SELECT 'Z' UNION SELECT '#2' UNION SELECT '_o%t' UNION SELECT 'nowhere')
SELECT needle, id FROM n JOIN u ON title ILIKE '%' || needle || '%' OR coalesce(summary ILIKE '%' || needle || '%', false)""")
def substring_postings(spark, d):
    """Substrings of names looked up in postings, a tenth of whose rows have changed since they were written and some of which are gone."""
    path = scratch(spark, "postings")
    rows = policy_queries.policies(spark, d).select("id", "title", "summary")
    postings.add(rows, path, ["title", "summary"], 0)
    changed = F.when(F.col("id") % 10 == 0, F.concat(F.upper("title"), F.lit(" zz"), F.col("id") % 7)).otherwise(F.col("title"))
    later = rows.where("id % 15 <> 5").withColumn("title", changed)
    moved = search.sync(rows.withColumn("updated_at", F.lit(0)), later, "id", ["title", "summary"], F.lit(1)).where("outcome <> 'unchanged'")
    postings.add(moved, path, ["title", "summary"], 1)
    needles = table(spark, d, "part").select(F.substring("p_name", 3, 5).alias("needle")).union(spark.createDataFrame([("zz3",), ("Z",), ("#2",), ("_o%t",), ("nowhere",)], "needle string")).distinct()
    return postings.search(later, path, needles.withColumn("terms", F.array("needle")), ["title", "summary"])


@_query(f"""WITH RECURSIVE {_TREE}, c AS (SELECT c_custkey AS policy, CASE WHEN c_custkey % 11 = 0 THEN 'nationwide' WHEN c_custkey % 7 = 0 THEN NULL ELSE 'regional' END AS scope, c_nationkey, c_acctbal FROM customer),
rules AS (SELECT policy, CASE WHEN c_acctbal < 1000 THEN 'exclude' ELSE 'include' END AS relation, 'n' || c_nationkey AS code, policy % 17 <> 0 AS good, 's' || (policy % 3) AS scheme FROM c WHERE policy % 13 <> 0
  UNION ALL SELECT policy, 'include', 'r' || (policy % 5), policy % 19 <> 0, 's' || (policy % 2) FROM c WHERE policy % 3 = 0 UNION ALL SELECT policy, 'include', 'world', true, 's9' FROM c WHERE policy % 41 = 0),
q AS (SELECT o_orderkey, o_custkey AS policy, CASE o_orderkey % 4 WHEN 0 THEN 'r' || (o_orderkey % 5) WHEN 1 THEN 'n' || (o_orderkey % 25) WHEN 2 THEN 'world' ELSE 'n' || c_nationkey END AS region FROM orders JOIN c ON c.policy = o_custkey WHERE o_orderstatus = 'P'),
pairs AS (SELECT DISTINCT region, policy FROM q),
m AS (SELECT region, pairs.policy, relation, rules.code, good, scheme, up.distance AS above, dn.distance AS under FROM pairs JOIN rules ON rules.policy = pairs.policy LEFT JOIN closure up ON up.code = region AND up.ancestor = rules.code LEFT JOIN closure dn ON dn.code = rules.code AND dn.ancestor = region AND dn.distance > 0),
per AS (SELECT region, policy, count(*) FILTER (WHERE good AND relation = 'exclude' AND above IS NOT NULL) AS shut, min(above) FILTER (WHERE good AND relation = 'include') AS near, min(under) FILTER (WHERE good AND relation = 'include') AS deep,
  count(*) FILTER (WHERE good AND relation = 'include') AS includes, count(*) FILTER (WHERE NOT good) AS lost,
  min({{'d': above, 's': scheme, 'c': code}}) FILTER (WHERE good AND relation = 'exclude' AND above IS NOT NULL) AS e1, min({{'d': above, 's': scheme, 'c': code}}) FILTER (WHERE good AND relation = 'include' AND above IS NOT NULL) AS e2,
  min({{'d': under, 's': scheme, 'c': code}}) FILTER (WHERE good AND relation = 'include' AND under IS NOT NULL) AS e3 FROM m GROUP BY region, policy),
v AS (SELECT pairs.*, CASE WHEN scope = 'nationwide' THEN 'match/nationwide' WHEN scope IS NULL THEN 'unknown/policy_unknown' WHEN shut > 0 THEN 'mismatch/exclude' WHEN near = 0 THEN 'match/exact' WHEN near > 0 THEN 'match/ancestor' WHEN deep > 0 THEN 'match/descendant'
  WHEN coalesce(includes, 0) = 0 OR lost > 0 THEN 'unknown/unresolved_rule' ELSE 'mismatch/other_region' END AS k, e1, e2, e3 FROM pairs JOIN c ON c.policy = pairs.policy LEFT JOIN per ON per.policy = pairs.policy AND per.region = pairs.region)
SELECT region, policy, split_part(k, '/', 1) AS verdict, split_part(k, '/', 2) AS reason, CASE split_part(k, '/', 2) WHEN 'exclude' THEN e1.c WHEN 'exact' THEN e2.c WHEN 'ancestor' THEN e2.c WHEN 'descendant' THEN e3.c END AS code,
  CASE split_part(k, '/', 2) WHEN 'exclude' THEN e1.s WHEN 'exact' THEN e2.s WHEN 'ancestor' THEN e2.s WHEN 'descendant' THEN e3.s END AS scheme, CAST(CASE split_part(k, '/', 2) WHEN 'exclude' THEN e1.d WHEN 'exact' THEN e2.d WHEN 'ancestor' THEN e2.d WHEN 'descendant' THEN e3.d END AS INT) AS distance FROM v""")
def region_pairs(spark, d):
    """Verdicts and the deciding rule for a table of regions and policies, by intervals of a walk around the tree."""
    c = table(spark, d, "customer").withColumn("policy", F.col("c_custkey"))
    p = F.col("policy")
    own = c.where("policy % 13 <> 0").select("policy", F.when(F.col("c_acctbal") < 1000, "exclude").otherwise("include").alias("relation"), F.concat(F.lit("n"), "c_nationkey").alias("code"), F.when(p % 34 == 0, "unmapped").otherwise("matched").alias("resolution"), F.when(p % 17 == 0, "retired").otherwise("active").alias("region_status"), F.concat(F.lit("s"), p % 3).alias("scheme"))
    wide = c.where("policy % 3 = 0").select("policy", F.lit("include").alias("relation"), F.concat(F.lit("r"), p % 5).alias("code"), F.when(p % 19 == 0, "ambiguous").otherwise("matched").alias("resolution"), F.lit("active").alias("region_status"), F.concat(F.lit("s"), p % 2).alias("scheme"))
    whole = c.where("policy % 41 = 0").select("policy", F.lit("include").alias("relation"), F.lit("world").alias("code"), F.lit("matched").alias("resolution"), F.lit("active").alias("region_status"), F.lit("s9").alias("scheme"))
    scope = F.when(p % 11 == 0, "nationwide").when(p % 7 == 0, F.lit(None)).otherwise("regional")
    k = F.col("o_orderkey")
    region = F.when(k % 4 == 0, F.concat(F.lit("r"), k % 5)).when(k % 4 == 1, F.concat(F.lit("n"), k % 25)).when(k % 4 == 2, F.lit("world")).otherwise(F.concat(F.lit("n"), "c_nationkey"))
    pairs = table(spark, d, "orders").where("o_orderstatus = 'P'").join(c, F.col("o_custkey") == p).select(region.alias("region"), "policy")
    found = verdict.regions(pairs, c.select("policy", scope.alias("scope")), own.unionByName(wide).unionByName(whole), verdict.intervals(_tree(spark, d)))
    return found.select("region", "policy", "verdict", "reason", "evidence.code", "evidence.scheme", "evidence.distance")
