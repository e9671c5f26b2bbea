"""Many questions in one plan: a table of questions meets the policies that can answer them, and each gets its best answers.

Which policies can answer a question comes from the postings of its terms, so the pairs are those with text evidence, not
all questions with all policies. On a pair, conditions become verdicts as in ``search.evaluate``, which takes one question;
the results are the same. Each question's best are chosen by a window that Spark bounds within each partition before rows
meet, so a question that very many policies answer sends few.

``grouped`` does this for very many questions: a text is looked through once for all questions with the same terms, and what
it is worth to them is then counted by the policies' other values (``kinds``), so that questions meet kinds of policies with their
number and smallest id instead of the policies. Policies with values of their own are kinds of one.

A question has an id and at least one term or keyword (one without any is not answered here: it asks for a list of all
policies). Other columns may be missing or null; nulls mean not asked for. Repeated question ids are an error of the caller.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightweir.functions.text import folded
from brightweir.operators import postings, search, verdict
from brightweir.session import cut, scratch

#: Columns of a question and their types.
COLUMNS = {"terms": "array<string>", "keyword": "string", "status": "string", "age": "int", "category": "string", "region": "string", "include_partial": "boolean", "wanted_categories": "array<string>", "wanted_age": "int", "preferred_region": "string"}
TEXTS = ["search_text", "title", "summary"]
#: What a question says, in which very many agree, and what of a policy counts besides its texts.
SAID = ["said", "must", "any_of", "folds"]
VALUES = ["quality", "has_status", "age_min", "age_max", "age_text", "categories", "regions", "scope"]
#: Tasks that questions and kinds meet in, and how many of them share the questions with the same terms.
TASKS, SHARES = 256, 8


def _distinct(terms: Column) -> Column:
    """Trimmed, without empty ones, the first of those that differ in case alone."""
    own = F.filter(F.transform(terms, lambda t: F.trim(t)), lambda t: t != "")
    low = F.transform(own, lambda x: F.lower(x))
    return F.filter(own, lambda t, i: F.array_position(low, F.lower(t)) == i + 1)


def prepared(questions: DataFrame) -> DataFrame:
    """questions with all columns, said (all terms), must (those that must occur), any_of (of which one must where must is
    empty) and folds (the different terms folded)."""
    q = questions.select("question", *[(F.col(c) if c in questions.columns else F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items()])
    terms, keyword = F.coalesce("terms", F.array().cast("array<string>")), F.nullif(F.col("keyword"), F.lit(""))
    said = _distinct(F.when(keyword.isNotNull(), F.array_append(terms, keyword)).otherwise(terms))
    generic = F.array(*map(F.lit, sorted(search.GENERIC)))
    must = F.filter("said", lambda t: ~F.array_contains(generic, F.lower(t)))
    must = F.when(keyword.isNotNull() & ~F.array_contains(must, keyword), F.array_append(must, keyword)).otherwise(must)
    q = q.withColumn("said", said).withColumns({"must": must, "any_of": _distinct(terms), "include_partial": F.coalesce("include_partial", F.lit(True))})
    each = q.select("question", F.posexplode("said").alias("at", "t")).withColumn("fold", folded(F.col("t")))
    folds = each.where("fold <> ''").groupBy("question").agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("at", "fold"))), lambda x: x["fold"])).alias("folds"))
    return q.join(folds, "question", "left").withColumn("folds", F.coalesce("folds", F.array().cast("array<string>")))


def pairs(asked: DataFrame, index: str) -> DataFrame:
    """(question, id): policies that have the rarest gram of what a question must have, or of one of the terms of which any will do."""
    needles = asked.select("question", F.posexplode(F.when(F.size("must") > 0, F.array("must")).otherwise(F.transform("any_of", lambda t: F.array(t)))).alias("at", "terms"))
    needles = needles.select(F.struct("question", "at").alias("needle"), "terms")
    return postings.candidates(asked.sparkSession, index, needles, unique=False).select("needle.question", "id").repartition("id").distinct()


def projected(policies: DataFrame) -> DataFrame:
    """policies (with the projection's texts) with folded texts, once for all questions."""
    return policies.withColumns({f"__{f}": folded(F.col(f)) for f in search.FIELDS})


def answers(policies: DataFrame, questions: DataFrame, index: str, regions: DataFrame | None = None, found: DataFrame | None = None) -> DataFrame:
    """(question, id, verdicts, counts, score and every sort key): policies that a question doesn't rule out.

    policies: from ``projected``; index: postings of TEXTS of their ids; regions: (region, policy, verdict, reason) from
    ``verdict.regions``, for asked and preferred regions; found: from ``pairs``, if it is there already."""
    asked = prepared(questions)
    own = policies.where(F.col("quality") != "invalid")
    rows = (pairs(asked, index) if found is None else found).join(asked, "question").join(own.withColumnRenamed("status", "has_status"), "id")
    # What is cheap to tell comes before the texts are looked through.
    return _placed(_told(_allowed(rows)), regions, "id")


def _allowed(rows: DataFrame) -> DataFrame:
    """Pairs that neither quality, status, age nor category rule out, with the verdicts."""
    rows = rows.where((F.col("include_partial") | (F.col("quality") == "valid")) & (F.col("status").isNotNull() | F.coalesce(F.col("has_status") != "closed", F.lit(True))))
    age = verdict.age(F.col("age"), F.col("age_min"), F.col("age_max"), F.col("age_text"))
    rows = rows.withColumns({"status_verdict": verdict.status(F.col("has_status"), F.col("status")), "age_verdict": age, "category_verdict": verdict.category(F.col("categories"), F.col("category"))})
    for v in ("status_verdict", "age_verdict", "category_verdict"):
        rows = rows.where(F.coalesce(F.col(v) != "mismatch", F.lit(True)))
    return rows


def _told(rows: DataFrame) -> DataFrame:
    """Pairs whose texts have what the question says, with the score."""
    texts = [F.col(c) for c in TEXTS]
    rows = rows.where(F.when(F.size("must") > 0, F.forall("must", lambda t: postings.holds(texts, t))).otherwise(F.exists("any_of", lambda t: postings.holds(texts, t))))

    def hits(field: str) -> Column:
        bare = F.replace(F.col(f"__{field}"), F.lit(" "), F.lit(""))
        return F.size(F.filter("folds", lambda x: F.contains(F.col(f"__{field}"), x) | F.contains(bare, F.replace(x, F.lit(" "), F.lit("")))))

    rows = rows.withColumns({f"hits_{f}": hits(f) for f in search.FIELDS})
    n = [F.col(f"hits_{f}") for f in search.FIELDS]
    shown = F.exists("said", lambda t: F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lower(t)) | F.contains(F.lower(F.coalesce("summary", F.lit(""))), F.lower(t)))
    missing = F.col("search_text").isNull()
    rows = rows.where(missing | (sum(n) > 0) | shown)
    return rows.withColumn("score", F.when(missing, 1.0).otherwise(F.lit(1.0) + sum(2.0 * (h > 0).cast("double") + h for h in n)))


def _placed(rows: DataFrame, regions: DataFrame | None, key: str) -> DataFrame:
    """Pairs that no region rules out, with counts and every sort key. regions: its policy is the column ``key`` of rows."""
    for name, column in (("region", "region"), ("liked", "preferred_region")):
        if regions is None:
            rows = rows.withColumns({f"{name}_verdict": F.lit(None).cast("string"), f"{name}_reason": F.lit(None).cast("string")})
        else:
            one = regions.select(F.col("region").alias(column), F.col("policy").alias(key), F.col("verdict").alias(f"{name}_verdict"), F.col("reason").alias(f"{name}_reason"))
            rows = rows.join(one, [column, key], "left")
    verdicts = ["status_verdict", "age_verdict", "category_verdict", "region_verdict"]
    rows = rows.where(F.coalesce(F.col("region_verdict") != "mismatch", F.lit(True)))
    have = F.coalesce(F.size("categories"), F.lit(0)) > 0
    wants = F.coalesce(F.size("wanted_categories"), F.lit(0)) > 0
    likes = [
        F.when(wants, F.when(~have, "unknown").when(F.arrays_overlap("categories", "wanted_categories"), "match").otherwise("mismatch")),
        verdict.age(F.col("wanted_age"), F.col("age_min"), F.col("age_max"), F.col("age_text")),
        F.when(F.col("preferred_region").isNotNull(), F.coalesce("liked_verdict", F.lit("unknown"))) if regions is not None else F.lit(None).cast("string"),
    ]
    count = lambda vs, what: sum((F.when(v == what, 1).otherwise(0) for v in vs), F.lit(0))
    rows = rows.withColumns({"preference_matches": count(likes, "match"), "preference_unknowns": count(likes, "unknown"), "unknown_count": count([F.col(v) for v in verdicts], "unknown")})
    group, breadth, relation = (F.when(F.col("region").isNotNull(), c).otherwise(0) for c in search.region_key(True, F.col("region_verdict"), F.col("region_reason"), F.coalesce(F.size("regions"), F.lit(0))))
    return rows.withColumns({"region_group": group, "region_breadth": breadth, "region_relation": relation, "status_rank": search.status_rank(F.col("has_status"))})


def grouped(policies: DataFrame, questions: DataFrame, index: str, regions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(groups, members). groups: as ``answers``, but a row for all policies that a question can't tell apart, with their
    number (n), the smallest id, and what names them (told, kind, score); members: (told, kind, score, id).

    policies and index: as in ``answers``; regions: (region, policy, verdict, reason), policy being struct(scope, regions)."""
    spark, asked = policies.sparkSession, prepared(questions)
    path = scratch(spark, "questions")
    asked.select(*SAID).distinct().withColumn("told", F.monotonically_increasing_id()).write.parquet(f"{path}/told")
    told = spark.read.parquet(f"{path}/told")
    # Of a text of ages only counts whether it says that there is no limit.
    free = F.regexp_replace("age_text", r"(?U)\s+", " ").contains(verdict.NO_LIMIT)
    own = policies.where(F.col("quality") != "invalid").withColumnRenamed("status", "has_status").withColumn("age_text", F.when(free, verdict.NO_LIMIT))
    own.select(*VALUES).distinct().withColumn("kind", F.monotonically_increasing_id()).write.parquet(f"{path}/kinds")
    kinds = spark.read.parquet(f"{path}/kinds")
    same = functools.reduce(Column.__and__, [F.col(f"own.{v}").eqNullSafe(F.col(f"kinds.{v}")) for v in VALUES])
    own = own.alias("own").join(kinds.alias("kinds"), same).select("own.id", *[f"own.{t}" for t in [*TEXTS, *[f"__{f}" for f in search.FIELDS]]], "kinds.kind")
    rows = _told(pairs(told.withColumnRenamed("told", "question"), index).withColumnRenamed("question", "told").join(told, "told").join(own, "id"))
    rows.select("told", "kind", "score", "id").write.parquet(f"{path}/members")
    members = spark.read.parquet(f"{path}/members")
    sets = members.groupBy("told", "kind", "score").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).join(kinds, "kind").withColumn("place", F.struct("scope", "regions"))
    share = F.pmod(F.xxhash64("question"), F.lit(SHARES))
    sets = sets.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long")))).repartition(TASKS, "told", "share")
    alike = functools.reduce(Column.__and__, [F.col(f"asked.{c}") == F.col(f"said.{c}") for c in SAID])
    asked = asked.alias("asked").join(told.alias("said"), alike).select("asked.*", "said.told").drop(*SAID, "terms", "keyword")
    return _placed(_allowed(asked.withColumn("share", share).repartition(TASKS, "told", "share").join(sets, ["told", "share"])), regions, "place"), members


def best_of(groups: DataFrame, members: DataFrame, top: int) -> DataFrame:
    """``best`` of what ``grouped`` gives: the first ``top`` answers are in the first ``top`` groups by their smallest ids."""
    key = ["told", "kind", "score"]
    first = cut(best(groups, top).drop("rank", "id", "n"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy("id"))
    ids = members.join(first.select(*key).distinct(), key, "left_semi").withColumn("place_", place).where(F.col("place_") <= top).drop("place_")
    return best(first.join(ids, key), top)


def best(found: DataFrame, top: int) -> DataFrame:
    """Each question's first ``top`` answers in the default order, with their rank from 1."""
    place = F.row_number().over(Window.partitionBy("question").orderBy(*search.default_order()))
    return found.withColumn("rank", place).where(F.col("rank") <= top)


def report(found: DataFrame, questions: DataFrame, confirmed: Column) -> DataFrame:
    """(question, matches, confirmed, unknown, first_id): how many policies answer each question, how many of them without
    doubt (all that was asked for matches, and ``confirmed`` holds), how many with a condition that is unknown, and the best one.
    found: from ``answers``, or the groups of ``grouped``."""
    n = F.col("n") if "n" in found.columns else F.lit(1)
    count = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0)).cast("long")
    sure = (F.col("unknown_count") == 0) & F.coalesce(confirmed, F.lit(False))
    keys = [*[c.alias(f"k{i}") for i, c in enumerate(_ascending())], F.col("id")]
    per = found.groupBy("question").agg(count(F.lit(True)).alias("matches"), count(sure).alias("confirmed"), count(F.col("unknown_count") > 0).alias("unknown"), F.min(F.struct(*keys)).alias("first"))
    rows = questions.select("question").join(per, "question", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("question", zero("matches"), zero("confirmed"), zero("unknown"), F.col("first.id").alias("first_id"))


def _ascending() -> list[Column]:
    """The default order as values of which the least comes first."""
    return [-F.col("score"), -F.col("preference_matches"), *[F.col(c) for c in ("preference_unknowns", "region_group", "region_breadth", "region_relation", "unknown_count", "status_rank")]]


def results(ranked: DataFrame) -> DataFrame:
    """Ranked answers as ``evidence.acceptance`` reads them: (scenario, id, rank, verdicts)."""
    kinds = ("status", "age", "category", "region")
    return ranked.select(F.col("question").alias("scenario"), "id", "rank", F.create_map(*functools.reduce(list.__add__, [[F.lit(k), F.col(f"{k}_verdict")] for k in kinds])).alias("verdicts"))
