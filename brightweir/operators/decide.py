"""Decisions about policies: duplicates across sources, review admission, the regional gate, youth targets, outcomes."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightweir.operators.normalize import NATIONWIDE, youth_marked
from brightweir.session import cut

# Marker words of the youth taxonomy by group.
TAXONOMY = {
    "direct": ("청년", "청소년", "대학생"),
    "family_parent": ("신혼부부", "예비신혼부부", "미혼모", "미혼부", "청소년부모"),
    "care_independence": ("가족돌봄청년", "가족돌봄청소년", "영케어러", "자립준비청년", "보호종료아동"),
    "vulnerable_transition": ("고립청년", "은둔청년", "학교밖청소년", "가정밖청소년", "쉼터퇴소청소년", "경계선지능청년", "장애청년", "저소득청년", "주거취약청년", "다문화청년", "탈북청년", "니트청년", "구직단념청년", "장기미취업청년", "전입청년", "지역정착청년"),
    "employment_education": ("취업준비생", "구직자", "미취업자", "졸업생", "졸업예정자", "대학원생", "학자금", "장학생", "사회초년생", "신입사원"),
    "household_business": ("1인가구", "예비창업자", "초기창업", "스타트업", "귀농", "후계농", "청년농업인", "청년창업자"),
    "cohort_military": ("2030세대", "ROTC", "학군사관후보생", "사관후보생", "군복무", "전역자", "전역청년"),
}
# Reasons that admit or block a region, and that say an application is open.
REGION_REASONS = ("source_region_confirmed", "target_region_confirmed", "implementing_region_confirmed")
REGION_BLOCKERS = ("insufficient_regional_evidence", "nationwide_republication", "region_conflict", "ambiguous_parent_region")
OPEN_REASONS = ("application_period_open", "application_explicitly_open", "source_scope_application_open")


def taxonomy(key: Column, groups: dict[str, tuple[str, ...]] = TAXONOMY) -> Column:
    """Sorted group/marker pairs whose marker a comparison key (letters and digits in lower case) contains."""
    hits = [F.when(key.contains("".join(x for x in m.casefold() if x.isalnum())), f"{g}/{m}") for g, ms in groups.items() for m in ms]
    return F.array_sort(F.array_compact(F.array(*hits)))


#: Beginnings of keys, some 100 bytes each, that go to every worker.
FEW = 50_000


# Duplicates -----------------------------------------------------------------------------------------------------------
def contained_titles(left: DataFrame, right: DataFrame, least: int = 5) -> DataFrame:
    """left and right (id, key): pairs (a, b) of which one key, of ``least`` characters or more, is a proper part of the other.

    A containment is an equi-join: where a part of ``least`` characters begins a shorter key, the longer key gives the parts
    of all lengths that keys with that beginning have, and these must be whole keys. So only pairs that are found meet.

    Keys may be far longer than Spark takes them to be, and a key is a row for each of its parts, so which side goes to every
    worker is not left to Spark: beginnings do, if few, and else nothing."""

    def half(short: DataFrame, long: DataFrame, a: str, b: str) -> DataFrame:
        whole = short.where(F.length("key") >= least).select(F.col("id").alias(a), F.col("key").alias("s"))
        heads = whole.groupBy(F.substring("s", 1, least).alias("g")).agg(F.collect_set(F.length("s")).alias("lengths"))
        spots = F.transform(F.sequence(F.lit(1), F.length("key") - (least - 1)), lambda i: F.struct(F.substring("key", i, F.lit(least)).alias("g"), F.substring(F.col("key"), i, F.length("key")).alias("rest")))
        body = long.where(F.length("key") > least).select(F.col("id").alias(b), F.length("key").alias("n"), F.explode(spots).alias("x")).select(b, "n", "x.g", "x.rest")
        heads = cut(heads)
        heads = F.broadcast(heads) if heads.count() <= FEW else heads.hint("merge")
        parts = body.join(heads, "g").select(b, "rest", F.explode(F.filter("lengths", lambda m: (m < F.col("n")) & (m <= F.length("rest")))).alias("m"))
        return whole.join(parts.select(b, F.substring(F.col("rest"), F.lit(1), F.col("m")).alias("s")).hint("merge"), "s").select(a, b)

    return half(left, right, "a", "b").unionByName(half(right, left, "b", "a")).distinct()


def duplicate_decisions(candidates: DataFrame, baseline: DataFrame | None) -> DataFrame:
    """One row a candidate: (id, outcome, reason, matches), the first of eight steps that has an answer.

    Both sides: id, title_key, org_key, support_key (comparison texts, '' for none), region_keys (sorted array),
    application_start, application_end, urls and announcements (arrays of canonical values); candidates also references
    (ids in the baseline). Steps: no baseline, stated reference, address (one, or several), announcement, full
    fingerprint, same title (with incomplete or with differing evidence), title within title, none. Each step is an
    equi-join; matches are counted before they meet the candidates. Texts and lists may be far longer than Spark takes them to
    be, so no side is broadcast."""
    ids = candidates.select("id")
    if baseline is None:
        return ids.select("id", F.lit("duplicate_review_required").alias("outcome"), F.lit("aggregator_baseline_unavailable").alias("reason"), F.lit(0).cast("long").alias("matches"))

    def by(mine: DataFrame, theirs: DataFrame, on: list[str]) -> DataFrame:
        return mine.join(theirs.hint("merge"), on).select("id", "b").distinct()

    def values(df: DataFrame, col: str, name: str) -> DataFrame:
        return df.select(F.col("id").alias(name), F.explode(col).alias("v"))

    stated = by(values(candidates, "references", "id"), baseline.select(F.col("id").alias("v"), F.col("id").alias("b")), ["v"])
    address = by(values(candidates, "urls", "id"), values(baseline, "urls", "b"), ["v"])
    notice = by(values(candidates, "announcements", "id"), values(baseline, "announcements", "b"), ["v"])
    # Two dates that are both missing are equal here; all other fields must be there.
    whole = ["title_key", "org_key", "region_keys", "support_key"]
    there = (F.col("title_key") != "") & (F.col("org_key") != "") & (F.col("support_key") != "") & (F.size("region_keys") > 0)
    span = F.concat_ws("~", F.coalesce(F.col("application_start").cast("string"), F.lit("-")), F.coalesce(F.col("application_end").cast("string"), F.lit("-"))).alias("span")
    # The baseline is brought down to a row a value before it meets the candidates, as one title or content may be very frequent.
    same = baseline.where(there).select("id", *whole, span).groupBy(*whole, "span").agg(F.count_distinct("id").alias("full"))
    full = candidates.where(there).select("id", *whole, span).join(same.hint("merge"), [*whole, "span"]).select("id", "full")
    thin = ((F.col("org_key") == "") | (F.col("support_key") == "") | (F.size("region_keys") <= 0) | F.col("application_start").isNull() | F.col("application_end").isNull()).alias("thin")
    titles = baseline.groupBy("title_key").agg(F.count(F.lit(1)).alias("titled"), F.bool_or(thin).alias("b_thin"))
    titled = candidates.select("id", "title_key", thin).join(titles.hint("merge"), "title_key").select("id", "titled", (F.col("thin") | F.col("b_thin")).alias("incomplete"))
    within = contained_titles(candidates.select("id", F.col("title_key").alias("key")), baseline.select("id", F.col("title_key").alias("key"))).select(F.col("a").alias("id"), "b")
    steps = [("stated", stated), ("address", address), ("notice", notice), ("within", within)]
    out = ids
    for name, pairs in steps:
        out = out.join(pairs.groupBy("id").agg(F.count(F.lit(1)).alias(name)).hint("merge"), "id", "left")
    out = out.join(full.hint("merge"), "id", "left").join(titled.hint("merge"), "id", "left")
    has = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    kinds = (
        F.when(has("stated"), "excluded_aggregator_duplicate/aggregator_external_id_match/stated")
        .when(F.col("address") == 1, "excluded_aggregator_duplicate/canonical_url_match/address")
        .when(has("address"), "duplicate_review_required/canonical_url_matches_multiple_policies/address")
        .when(has("notice"), "excluded_aggregator_duplicate/official_announcement_id_match/notice")
        .when(has("full"), "duplicate_review_required/full_fingerprint_match_requires_review/full")
        .when(has("titled") & F.col("incomplete"), "duplicate_review_required/same_title_with_incomplete_comparison_evidence/titled")
        .when(has("titled"), "accepted_regional/same_title_but_material_fields_differ/titled")
        .when(has("within"), "duplicate_review_required/material_title_containment_requires_review/within")
        .otherwise("accepted_regional/no_cross_source_candidate/")
    )
    p = F.split(kinds, "/")
    n = functools.reduce(lambda acc, c: F.when(p[2] == c, F.col(c)).otherwise(acc), ["stated", "address", "notice", "full", "titled", "within"], F.lit(0))
    return out.select("id", p[0].alias("outcome"), p[1].alias("reason"), n.cast("long").alias("matches"))


def alternative_match(candidates: DataFrame, baseline: DataFrame) -> DataFrame:
    """(id, match, via): the baseline row of the same id, else of the same url, else of the same title (smallest id each)."""
    out = candidates.select("id", "external", "url", "title")
    for col in ("external", "url", "title"):
        first = baseline.where(F.col(col).isNotNull()).groupBy(F.col(col).alias(f"{col}_key")).agg(F.min("id").alias(f"by_{col}"))
        out = out.join(first, out[col] == first[f"{col}_key"], "left").drop(f"{col}_key")
    via = F.when(F.col("by_external").isNotNull(), "id").when(F.col("by_url").isNotNull(), "url").when(F.col("by_title").isNotNull(), "title")
    return out.select("id", F.coalesce("by_external", "by_url", "by_title").alias("match"), via.alias("via"))


def conflicts(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one different value, with how many."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(value).alias("n")).where("n > 1")


# Admission ------------------------------------------------------------------------------------------------------------
def admission() -> tuple[Column, Column]:
    """(outcome, reason) of a review candidate, the first of fifteen cases that holds.

    Columns: identity_valid, checkpoint, application, markers (array), original and current (arrays of reasons; an empty
    current falls back to original), normalization, fingerprint, duplicate."""
    current = F.when(F.coalesce(F.size("current"), F.lit(0)) > 0, F.col("current")).otherwise(F.col("original"))
    has = lambda c, names: F.coalesce(F.arrays_overlap(c, F.array(*map(F.lit, names))), F.lit(False))
    told = F.exists(F.concat(F.coalesce("original", F.array().cast("array<string>")), F.coalesce(current, F.array().cast("array<string>"))), lambda r: r.startswith("youth_target_confirmed"))
    is_ = lambda c, *vs: F.coalesce(F.col(c).isin(*vs), F.lit(False))
    kinds = (
        F.when(~F.coalesce("identity_valid", F.lit(False)), "exclude_invalid/invalid_identity_url_or_provenance")
        .when(is_("checkpoint", "failed"), "exclude_failed/checkpoint_failed")
        .when(is_("checkpoint", "closed") | is_("application", "closed"), "exclude_closed/application_closed")
        .when(is_("checkpoint", "duplicate"), "exclude_duplicate/checkpoint_duplicate")
        .when(~is_("checkpoint", "review"), "hold_review/checkpoint_not_review")
        .when((F.coalesce(F.size("markers"), F.lit(0)) <= 0) & ~told, "hold_review/youth_target_unconfirmed")
        .when(has(current, REGION_BLOCKERS) | ~has(current, REGION_REASONS), "hold_review/regional_evidence_not_admissible")
        .when(~is_("application", "open") | ~has(current, OPEN_REASONS), "hold_review/current_application_unconfirmed")
        .when(is_("normalization", "invalid"), "exclude_invalid/normalized_program_invalid")
        .when(~is_("normalization", "valid", "partial"), "hold_review/normalization_contract_not_satisfied")
        .when(F.col("fingerprint").isNull(), "exclude_invalid/policy_fingerprint_missing")
        .when(is_("duplicate", "excluded_aggregator_duplicate", "excluded_intra_batch_duplicate"), "exclude_duplicate/duplicate_confirmed")
        .when(is_("duplicate", "duplicate_review_required"), "hold_review/duplicate_review_required")
        .when(~is_("duplicate", "accepted_regional"), "hold_review/duplicate_gate_unconfirmed")
        .otherwise("promote_partial/all_admission_conditions_satisfied")
    )
    p = F.split(kinds, "/")
    return p[0], p[1]


# Regional gate --------------------------------------------------------------------------------------------------------
def mentions(text: Column, aliases: Column) -> Column:
    return F.coalesce(F.exists(aliases, lambda a: text.contains(a)), F.lit(False))


def regionality(aliases: Column, source_code: Column, own_codes: Column, with_organization: bool = False) -> Column:
    """struct<state: string, reasons: string>. Columns: source_region, eligibility, organization, and jurisdiction and
    operator of the source's scope. aliases: names under the expected jurisdiction; source_code: the one code of the source
    region, if it has exactly one; own_codes: codes under the jurisdiction.

    with_organization: region or target together with the organization are enough."""
    region, target, org = (mentions(F.col(c), aliases) for c in ("source_region", "eligibility", "organization"))
    scoped = mentions(F.col("jurisdiction"), aliases) & mentions(F.col("operator"), aliases)
    whole = F.coalesce(F.col("source_region").contains(NATIONWIDE), F.lit(False)) | F.coalesce(F.col("eligibility").contains(NATIONWIDE), F.lit(False))
    other = source_code.isNotNull() & ~F.array_contains(own_codes, source_code)
    own = F.array_join(F.array_compact(F.array(F.when(region, "source_region_confirmed"), F.when(target, "target_region_confirmed"), F.when(org, "implementing_region_confirmed"))), "+")
    by_scope = F.array_join(F.array_compact(F.array(F.lit("source_scope_region_confirmed"), F.lit("source_scope_operator_confirmed"), F.when(target, "target_region_confirmed"), F.when(org, "implementing_region_confirmed"))), "+")
    row = lambda state, why: F.struct(F.lit(state).alias("state"), (why if isinstance(why, Column) else F.lit(why)).alias("reasons"))
    enough = (region & target & org) | (F.lit(with_organization) & org & (region | target))
    return (
        F.when(whole, row("non_regional", "nationwide_republication"))
        .when(other, row("non_regional", "other_region_policy"))
        .when(enough, row("regional_confirmed", own))
        .when(scoped & (target | org), row("regional_confirmed", by_scope))
        .otherwise(row("regional_review_required", "insufficient_regional_evidence"))
    )


def youth_target(texts: list[Column], age_text: Column, scope_text: Column) -> Column:
    """Why a policy counts as meant for young people; youth_target_unconfirmed if nothing says so."""
    by_scope = F.coalesce(youth_marked(scope_text) & age_text.rlike(r"(?<!\d)\d{1,3}\s*세(?!\w)"), F.lit(False))
    return F.when(youth_marked(*texts), "youth_target_confirmed").when(by_scope, "youth_target_confirmed_by_scope_and_age").otherwise("youth_target_unconfirmed")


def accepted(regional: Column, application: Column, youth: Column) -> Column:
    return (regional == "regional_confirmed") & (application == "open") & (youth != "youth_target_unconfirmed")


def outcome(application: Column, is_accepted: Column, duplicate_accepted: Column) -> Column:
    """closed, review, duplicate or accepted; duplicate_accepted is null where no such decision was made."""
    return F.when(application == "closed", "closed").when(~F.coalesce(is_accepted, F.lit(False)), "review").when(~F.coalesce(duplicate_accepted, F.lit(True)), "duplicate").otherwise("accepted")


def exclusion_reason(rows: DataFrame, exact: DataFrame, prefixes: dict[str, str], default: str) -> DataFrame:
    """rows (id): (id, reason), by exact id (exact: id, reason), else by the first prefix that fits, else the default."""
    by_prefix = F.coalesce(*[F.when(F.col("id").startswith(p), r) for p, r in prefixes.items()], F.lit(default))
    return rows.join(exact, "id", "left").select("id", F.coalesce("reason", by_prefix).alias("reason"))
