"""Search and recommendation: projections, candidates, evaluation, ranking."""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightweir.functions.text import compatible, compatible_all, folded, term_hits
from brightweir.operators import verdict

# Words too common to narrow a search by.
GENERIC = frozenset({"청년", "지원", "지원금", "정책", "사업", "혜택", "프로그램", "정보"})

# Which columns each text of the projection is made of, in this order.
PROJECTION = {
    "title_text": ("title",),
    "keyword_text": ("category_text", "categories", "keywords"),
    "summary_text": ("summary",),
    "eligibility_text": ("life_stages", "target_groups", "age_text", "eligibility_text", "education_statuses", "employment_statuses", "required_conditions", "preferred_conditions", "excluded_conditions"),
    "support_text": ("support_content",),
}
FIELDS = tuple(PROJECTION)


def _joined(parts: list[Column]) -> Column:
    """Parts (arrays of strings) one after another, each different one once, null for none."""
    return F.array_join(F.array_distinct(F.array_compact(F.flatten(F.array(*parts)))), " ")


def search_document(policies: DataFrame) -> DataFrame:
    """policies with the five texts of the projection and search_text, all of them together; columns that aren't there count
    as empty. Fragments are brought to NFKC with single spaces; a fragment counts once in a text."""
    kinds, out = dict(policies.dtypes), policies
    own = [c for cols in PROJECTION.values() for c in cols if c in kinds]
    for c in own:
        out = out.withColumn(f"__{c}", compatible_all(F.col(c)) if kinds[c].startswith("array") else F.array(compatible(c)))
    for name, cols in PROJECTION.items():
        some = [F.coalesce(F.col(f"__{c}"), F.array().cast("array<string>")) for c in cols if c in kinds]
        out = out.withColumn(name, _joined(some) if some else F.lit(""))
    out = out.drop(*(f"__{c}" for c in own))
    return out.withColumn("search_text", _joined([F.array(F.nullif(F.col(f), F.lit(""))) for f in FIELDS]))


def sync(current: DataFrame, fresh: DataFrame, key: str, values: list[str], now: Column) -> DataFrame:
    """Next state of a derived table: fresh rows; updated_at moves to ``now`` where a value changed and never back.
    Adds outcome: inserted, updated or unchanged."""
    a = current.select(key, *[F.col(v).alias(f"__{v}") for v in values], F.col("updated_at").alias("__at"), F.lit(True).alias("__had"))
    both = fresh.select(key, *values).join(a, key, "left")
    same = functools.reduce(Column.__and__, [F.col(v).eqNullSafe(F.col(f"__{v}")) for v in values])
    outcome = F.when(F.col("__had").isNull(), "inserted").when(same, "unchanged").otherwise("updated")
    out = both.withColumn("outcome", outcome)
    return out.select(key, *values, F.when(F.col("outcome") == "unchanged", F.col("__at")).otherwise(F.greatest("__at", now)).alias("updated_at"), "outcome")


def distinct_terms(terms: list[str]) -> list[str]:
    """Trimmed, without empty ones, the first of those that differ in case alone."""
    return list({t.strip().casefold(): t.strip() for t in reversed(terms) if t.strip()}.values())[::-1]


def anchors(terms: list[str], keyword: str | None = None) -> list[str]:
    """Terms to filter by: those that aren't generic, and an explicit keyword in any case."""
    own = [t for t in distinct_terms([*terms, *([keyword] if keyword else [])]) if t.casefold() not in GENERIC]
    return [*own, keyword] if keyword and keyword not in own else own


def candidates(docs: DataFrame, fields: list[str], terms: list[str], keyword: str | None = None) -> DataFrame:
    """Every anchor must occur in some field; if there is none, any term may. Wildcards in terms work as in LIKE."""
    narrow = anchors(terms, keyword)
    some = [functools.reduce(Column.__or__, [F.coalesce(F.col(f).ilike(f"%{t}%"), F.lit(False)) for f in fields]) for t in narrow or distinct_terms(terms)]
    return docs.where(functools.reduce(Column.__and__ if narrow else Column.__or__, some)) if some else docs


def relevance(docs: DataFrame, fields: list[str], terms: list[str]) -> DataFrame:
    """1 + 2 for each field with a hit + 1 for each hit, with the number of hits in each field."""
    out = docs.withColumns({f"__{f}": folded(F.col(f)) for f in fields})
    out = out.withColumns({f"hits_{f}": F.size(term_hits(F.col(f"__{f}"), terms)).cast("long") for f in fields}).drop(*(f"__{f}" for f in fields))
    hits = [F.col(f"hits_{f}") for f in fields]
    score = F.lit(1.0) + sum(2.0 * (h > 0).cast("double") + h for h in hits)
    return out.withColumn("score", score.cast("double"))


def ranked(df: DataFrame, keys: list[Column], top: int | None = None, offset: int = 0) -> DataFrame:
    """Rows with their rank from 1; a page of them only if ``top`` is given, which bounds what is ranked in one task."""
    if top is not None:
        df = df.orderBy(*keys).limit(offset + top)
    out = df.withColumn("rank", F.row_number().over(Window.orderBy(*keys)).cast("long"))
    return out.where(F.col("rank") > offset) if offset else out


@dataclass
class Request:
    """What is asked for; explicit conditions beat those that were read from the query text (``merged``)."""

    terms: list[str] = field(default_factory=list)
    keyword: str | None = None
    status: str | None = None
    age: int | None = None
    category: str | None = None
    region: str | None = None
    include_partial: bool = True
    wanted_categories: tuple[str, ...] = ()
    wanted_age: int | None = None
    wants_region: bool = False

    @classmethod
    def merged(cls, parsed: dict, explicit: dict) -> Request:
        return cls(**{k: v for k, v in (parsed | {k: v for k, v in explicit.items() if v is not None}).items()})


def status_rank(status: Column) -> Column:
    return F.when(status == "open", 0).when(status == "scheduled", 1).when(status == "closed", 3).otherwise(2)


def region_key(asked: bool, verdict_: Column, reason: Column, n_regions: Column) -> tuple[Column, Column, Column]:
    """Group, breadth and relation: direct and narrow first, then nationwide, unknown, and the rest."""
    far = F.lit(1_000_000)
    if not asked:
        return F.lit(0), F.lit(0), F.lit(0)
    group = F.when(verdict_ == "unknown", 2).when(F.coalesce(verdict_ != "match", F.lit(True)), 3).when(reason == "nationwide", 1).otherwise(0)
    near = F.greatest(n_regions, F.lit(1))
    relation = F.when(group != 0, 0).when(reason == "exact", 0).when(reason.isin("ancestor", "descendant"), 1).otherwise(2)
    return group, F.when(group == 0, near).otherwise(far), relation


def _preference(verdicts: list[Column]) -> tuple[Column, Column]:
    count = lambda what: sum((F.when(v == what, 1).otherwise(0) for v in verdicts), F.lit(0))
    return count("match"), count("unknown")


def evaluate(policies: DataFrame, request: Request, regions: DataFrame | None = None, preferred: DataFrame | None = None) -> DataFrame:
    """Policies that the request does not rule out, with verdicts, unknown_count, score and every sort key.

    policies: the contract's columns with the projection's texts. regions and preferred: (policy, verdict, reason) from
    ``verdict.region`` for the asked and the preferred region. Mismatches are dropped as plain conjuncts, so that scans can
    use them; closed policies are dropped unless a status is asked for; with terms, so are rows without any text evidence,
    but for rows without a projection."""
    rows = policies.where(F.col("quality") != "invalid") if request.include_partial else policies.where(F.col("quality") == "valid")
    if request.status is None:
        rows = rows.where(F.coalesce(F.col("status") != "closed", F.lit(True)))
    terms = distinct_terms([*request.terms, *([request.keyword] if request.keyword else [])])
    if terms:
        rows = candidates(rows, ["search_text", "title", "summary"], request.terms, request.keyword)
    own = {
        "status_verdict": verdict.status(F.col("status"), request.status),
        "age_verdict": verdict.age(F.lit(request.age).cast("int"), F.col("age_min"), F.col("age_max"), F.col("age_text")),
        "category_verdict": verdict.category(F.col("categories"), request.category),
    }
    rows = rows.withColumns(own)
    if request.region is not None and regions is not None:
        rows = rows.join(regions.select(F.col("policy").alias("id"), F.col("verdict").alias("region_verdict"), F.col("reason").alias("region_reason")), "id", "left")
    else:
        rows = rows.withColumns({"region_verdict": F.lit(None).cast("string"), "region_reason": F.lit(None).cast("string")})
    asked = ["status_verdict", "age_verdict", "category_verdict", "region_verdict"]
    for v in asked:
        rows = rows.where(F.coalesce(F.col(v) != "mismatch", F.lit(True)))
    likes = []
    if request.wanted_categories:
        have = F.coalesce(F.size("categories"), F.lit(0)) > 0
        likes.append(F.when(~have, "unknown").when(F.arrays_overlap("categories", F.array(*map(F.lit, request.wanted_categories))), "match").otherwise("mismatch"))
    if request.wanted_age is not None:
        likes.append(verdict.age(F.lit(request.wanted_age), F.col("age_min"), F.col("age_max"), F.col("age_text")))
    if request.wants_region and preferred is not None:
        rows = rows.join(preferred.select(F.col("policy").alias("id"), F.col("verdict").alias("__liked")), "id", "left")
        likes.append(F.coalesce("__liked", F.lit("unknown")))
    liked, unsure = _preference(likes)
    rows = rows.withColumns({"preference_matches": liked, "preference_unknowns": unsure}).drop("__liked")
    rows = rows.withColumn("unknown_count", _preference([F.col(v) for v in asked])[1])
    if terms:
        rows = relevance(rows, list(FIELDS), terms)
        said = [F.lower(F.coalesce(c, F.lit(""))).contains(t.lower()) for c in ("title", "summary") for t in terms]
        hit = sum(F.col(f"hits_{f}") for f in FIELDS) > 0
        missing = F.col("search_text").isNull()
        rows = rows.where(missing | hit | functools.reduce(Column.__or__, said)).withColumn("score", F.when(missing, 1.0).otherwise(F.col("score")))
        rows = rows.drop(*(f"hits_{f}" for f in FIELDS))
    else:
        rows = rows.withColumn("score", F.lit(1.0))
    group, breadth, relation = region_key(request.region is not None, F.col("region_verdict"), F.col("region_reason"), F.coalesce(F.size("regions"), F.lit(0)))
    return rows.withColumns({"region_group": group, "region_breadth": breadth, "region_relation": relation, "status_rank": status_rank(F.col("status"))})


def default_order() -> list[Column]:
    return [F.col("score").desc(), F.col("preference_matches").desc(), F.col("preference_unknowns"), F.col("region_group"), F.col("region_breadth"), F.col("region_relation"), F.col("unknown_count"), F.col("status_rank"), F.col("id")]


def listed_order(sort: str) -> list[Column]:
    """Order of the public list for an allowed sort; any other name gives the order of ids."""
    title, due, seen = F.lower("title"), F.col("application_end"), F.col("collected_at")
    keys = {
        "title_asc": title.asc(),
        "title_desc": title.desc(),
        "deadline_asc": due.asc_nulls_last(),
        "deadline_desc": due.desc_nulls_last(),
        "collected_desc": seen.desc(),
        "collected_asc": seen.asc(),
    }
    return [*([keys[sort]] if sort in keys else []), F.col("id")]


def user_order(sort: str) -> list[Column]:
    """A sort chosen for search results: ties stay in the default order. Titles fold case, as far as lower case does."""
    return [*listed_order(sort)[:-1], *default_order()]


def page(df: DataFrame, keys: list[Column], number: int, size: int) -> DataFrame:
    """One page with rank and the total of all rows on each of its rows."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    own = ranked(df, keys, top=size, offset=(number - 1) * size)
    return own.join(F.broadcast(total))  # one row


def recommendation(category: Column, region: Column, age: Column, have: Column, want: str | None = None) -> tuple[Column, Column, Column]:
    """(excluded, score, reasons) of verdicts and the status that a policy has: 30 for category, region and age each, 10 for
    being open unless another status is asked for. Closed policies are excluded; with a status asked for, so are those that
    have another or none."""
    want = "scheduled" if want == "upcoming" else want
    parts = [("category", category, 30), ("region", region, 30), ("age", age, 30)]
    gone = [F.coalesce(v == "mismatch", F.lit(False)) for _, v, _ in parts]
    gone.append(F.coalesce(have == "closed", F.lit(False)) if want is None else F.coalesce(have != want, F.lit(True)))
    is_open = F.coalesce(have == "open", F.lit(False)) & F.lit(want in (None, "open"))
    score = sum(F.when(v == "match", n).otherwise(0) for _, v, n in parts) + F.when(is_open, 10).otherwise(0)
    said = [F.when(v == "match", n).when(v == "unknown", f"{n}?") for n, v, _ in parts]
    return functools.reduce(Column.__or__, gone), score.cast("long"), F.array_join(F.array_compact(F.array(*said, F.when(is_open, "open"))), ",")


def recommended_region_key(asked: bool, verdict_: Column, reason: Column, n_regions: Column) -> tuple[Column, Column]:
    """Direct regions by how many there are, then nationwide, unconfirmed, none."""
    if not asked:
        return F.lit(0), F.lit(0)
    far = F.lit(1_000_000)
    group = F.when(verdict_ == "unknown", 3).when(F.coalesce(verdict_ != "match", F.lit(True)), 4).when(reason == "nationwide", 2).otherwise(0)
    return group, F.when(group == 0, F.greatest(n_regions, F.lit(1))).otherwise(far)


def recommended_item(policies: DataFrame) -> DataFrame:
    """What a recommendation shows: first category, else its text, else the word for other; days as text; status or unknown."""
    first = F.coalesce(F.try_element_at("categories", F.lit(1)), F.col("category_text"), F.lit("기타"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return policies.select("id", "source_id", F.coalesce("external_id", F.lit("")).alias("external_id"), first.alias("category"), day("application_start").alias("application_start"), day("application_end").alias("application_end"), F.coalesce("status", F.lit("unknown")).alias("status"))
