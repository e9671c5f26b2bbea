"""Validation of normalised programs: contract, semantic rules, gaps, and the quality class that follows from them.

Issues are strings path|code|severity in an array; rows stay rows, so a partition into classes is a filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_LIMIT = "제한 없음"
#: Allowed values by column; arrays are checked value by value.
ENUMS = {
    "categories": ("housing", "finance", "welfare", "employment", "startup", "education", "other"),
    "schedule": ("always", "until_budget_exhausted", "fixed_period"),
    "status": ("open", "closed", "scheduled"),
    "scope": ("nationwide", "regional", "unknown"),
}


def _issue(when: Column, path: str, code: str, severity: str = "error") -> Column:
    return F.when(F.coalesce(when, F.lit(False)), f"$.{path}|{code}|{severity}")


def _outside(col: str, allowed: tuple[str, ...], kind: str) -> Column:
    return F.exists(col, lambda x: ~x.isin(*allowed)) if kind.startswith("array") else F.col(col).isNotNull() & ~F.col(col).isin(*allowed)


def schema_issues(kinds: dict[str, str], required: tuple[str, ...] = (), longest: dict[str, int] | None = None) -> Column:
    """Issues of a row against the contract: required values, allowed values, lengths, numbers from 0 to 150, unique array values."""
    out = [_issue(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), c, "required") for c in required if c in kinds]
    out += [_issue(_outside(c, allowed, kinds[c]), c, "enum") for c, allowed in ENUMS.items() if c in kinds]
    for c in ("age_min", "age_max"):
        if c in kinds:
            out += [_issue(F.col(c) < 0, c, "minimum"), _issue(F.col(c) > 150, c, "maximum")]
    out += [_issue(F.size(F.array_distinct(c)) < F.size(c), c, "uniqueItems") for c, k in kinds.items() if k == "array<string>"]
    out += [_issue(F.length(c) > n, c, "maxLength") for c, n in (longest or {}).items() if c in kinds]
    return F.array_compact(F.array(*out)) if out else F.array().cast("array<string>")


def semantic_issues(rules: str | None = None) -> Column:
    """Order of dates and ages; with the name of a rules column (array of structs relation, resolution, scheme, code,
    source_code, source_text), the eight rules of the region contract."""
    out = F.array_compact(F.array(_issue(F.col("application_start") > F.col("application_end"), "application_end", "date_order"), _issue(F.col("age_min") > F.col("age_max"), "age_max", "age_order")))
    return F.concat(out, region_issues(F.col(rules), F.col("scope"))) if rules else out


def region_issues(rules: Column, scope: Column) -> Column:
    resolved = lambda r: (r["resolution"] == "matched") & r["scheme"].isNotNull() & r["code"].isNotNull()
    good = F.filter(rules, resolved)
    key = lambda r: F.concat_ws("\x1f", r["scheme"], r["code"])
    whole = F.transform(good, lambda r: F.concat_ws("\x1f", key(r), r["relation"]))
    places = lambda kind: F.transform(F.filter(good, lambda r: r["relation"] == kind), key)
    open_ = lambda r: r["resolution"].isin("unmapped", "ambiguous")
    some = lambda test: F.exists(rules, lambda r: F.coalesce(test(r), F.lit(False)))
    return F.array_compact(
        F.array(
            _issue(some(lambda r: (r["resolution"] == "matched") & (r["scheme"].isNull() | r["code"].isNull())), "region_rules", "matched_region_reference"),
            _issue(F.size(F.array_distinct(whole)) < F.size(whole), "region_rules", "duplicate_region_relation"),
            _issue(some(lambda r: open_(r) & (r["scheme"].isNotNull() | r["code"].isNotNull())), "region_rules", "unresolved_canonical_region"),
            _issue(some(lambda r: open_(r) & r["source_code"].isNull() & r["source_text"].isNull()), "region_rules", "missing_region_evidence"),
            _issue((scope == "nationwide") & (F.size(rules) > 0), "region_rules", "nationwide_region_rules"),
            _issue((scope == "regional") & ~F.coalesce(F.exists(good, lambda r: r["relation"] == "include"), F.lit(False)), "coverage_scope", "regional_without_include"),
            _issue((scope == "unknown") & (F.size(good) > 0), "coverage_scope", "unknown_with_matched_region"),
            _issue(F.arrays_overlap(places("include"), places("exclude")), "region_rules", "region_include_exclude_conflict"),
        )
    )


def gap_issues() -> Column:
    """The gaps that make a row partial: no categories, regions, age condition or period, or one that has no structure."""
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    dates = F.col("application_start").isNull() & F.col("application_end").isNull()
    nothing = F.col("period_text").isNull() & dates & F.col("schedule").isNull() & F.col("status").isNull()
    return F.array_compact(
        F.array(
            _issue(none("categories"), "categories", "missing_categories", "warning"),
            _issue(none("regions"), "regions", "missing_regions", "warning"),
            _issue(F.col("age_text").isNull(), "age_condition_text", "missing_age_condition", "warning"),
            _issue(F.col("age_min").isNull() & F.col("age_max").isNull() & ~F.col("age_text").contains(NO_LIMIT), "age_condition_text", "unstructured_age_condition", "warning"),
            _issue(nothing, "application_period_text", "missing_application_period", "warning"),
            _issue(~nothing & (F.col("schedule") == "fixed_period") & dates, "application_period_text", "missing_fixed_period_dates", "warning"),
        )
    )


def validated(programs: DataFrame, required: tuple[str, ...] = (), rules: str | None = None, noted: str | None = None, longest: dict[str, int] | None = None) -> DataFrame:
    """programs with issues (each path, code and severity once) and class: invalid on any error, else partial on any issue,
    else valid. noted: a column with issues that normalisation found. Gaps are only looked for in rows without errors."""
    before = F.coalesce(F.col(noted), F.array().cast("array<string>")) if noted else F.array().cast("array<string>")
    hard = F.concat(schema_issues(dict(programs.dtypes), required, longest), semantic_issues(rules), before)
    out = programs.withColumn("issues", F.array_distinct(hard))
    wrong = F.exists("issues", lambda x: x.endswith("|error"))
    out = out.withColumn("issues", F.when(wrong, F.col("issues")).otherwise(F.array_distinct(F.concat("issues", gap_issues()))))
    return out.withColumn("class", F.when(wrong, "invalid").when(F.size("issues") > 0, "partial").otherwise("valid"))


def partitions(classified: DataFrame) -> dict[str, DataFrame]:
    return {c: classified.where(F.col("class") == c) for c in ("valid", "partial", "invalid")}


def provenance_faults(provenance: Column, collected: Column) -> Column:
    """provenance: array of structs id, collected_at: ids must differ, and the newest must be when the row was collected."""
    ids = F.transform(provenance, lambda p: p["id"])
    newest = F.array_max(F.transform(provenance, lambda p: p["collected_at"]))
    return F.array_compact(F.array(F.when(F.size(provenance) <= 0, "provenance_missing"), F.when(F.size(F.array_distinct(ids)) < F.size(ids), "provenance_id_repeated"), F.when(~newest.eqNullSafe(collected), "collected_at_differs")))
