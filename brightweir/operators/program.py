"""The whole normalised program: a row with every field of the contract from what an extractor found, and records from rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightweir.functions import parsing, periods
from brightweir.functions.text import visible_text
from brightweir.operators import normalize, validate

# The contract's version, those that can be read, and its fields in order.
VERSION, READABLE = "1.2.0", ("1.1.0", "1.2.0")
FIELDS = (
    "schema_version", "source_id", "source_name", "external_id", "title", "organization", "summary", "category_text", "categories", "keywords", "life_stages", "target_groups", "application_period_text", "application_start", "application_end",
    "application_schedule", "application_status", "region_text", "regions", "coverage_scope", "region_rules", "age_min", "age_max", "age_condition_text", "eligibility_text", "eligibility_summary", "support_content", "application_method",
    "education_statuses", "employment_statuses", "required_conditions", "preferred_conditions", "excluded_conditions", "source_url", "collected_at", "provenance", "data_quality_status",
)
TEXTS = ("source_name", "title", "organization", "summary", "category_text", "application_period_text", "region_text", "age_condition_text", "eligibility_text", "support_content", "application_method")
LISTS = ("keywords", "life_stages", "target_groups")
EMPTY = ("education_statuses", "employment_statuses", "required_conditions", "preferred_conditions", "excluded_conditions")


def normalized(extracted: DataFrame, names: DataFrame, blank_zero_ages: tuple[str, ...] = (), required: tuple[str, ...] = ("source_id", "external_id", "title")) -> DataFrame:
    """extracted (an id, and TEXTS, LISTS, source_id, external_id, source_url, collected_at, provenance, eligibility_summary, of
    which any may be missing) as rows of FIELDS, with the id and issues. names: (name, code, full_name) of regions.

    Texts are made visible first; periods are read as of the day of collection in Korea; ages of 0 to 0 are blank for the
    sources of ``blank_zero_ages``; regions are the parts of the region's text that have one code. Rows whose id is null or
    repeated are an error of the caller."""
    have = dict(extracted.dtypes)
    rows = extracted.withColumns({c: visible_text(c) if c in have else F.lit(None).cast("string") for c in TEXTS})
    none = F.array().cast("array<string>")
    rows = rows.withColumns({c: F.array_distinct(F.filter(F.transform(F.coalesce(F.col(c), none), lambda x: F.trim(x)), lambda x: x != "")) if c in have else none for c in LISTS})
    more = {"source_url": "string", "collected_at": "timestamp", "provenance": "array<struct<id: string, collected_at: timestamp>>", "eligibility_summary": "array<struct<kind: string, text: string>>", "source_id": "string", "external_id": "string"}
    rows = rows.withColumns({c: F.lit(None).cast(t) for c, t in more.items() if c not in have})
    rows = rows.withColumns({"__c": normalize.categories(F.col("category_text")), "__p": parsing.period(F.col("application_period_text"), periods.day(F.col("collected_at"), "Asia/Seoul"))})
    zero = F.coalesce(F.col("source_id").isin(*blank_zero_ages), F.lit(False)) if blank_zero_ages else F.lit(False)
    rows = rows.withColumn("__a", F.when(zero, parsing.age_limits(F.col("age_condition_text"), True)).otherwise(parsing.age_limits(F.col("age_condition_text"), False)))
    parts = normalize.tokens(F.col("region_text"), "[,|/]")
    whole = F.coalesce(F.array_contains(parts, normalize.NATIONWIDE), F.lit(False))
    told = rows.select(F.col("id").alias("policy"), F.posexplode(F.when(~whole, parts)).alias("pos", "source_text")).withColumn("relation", F.lit("include"))
    regions = normalize.region_contract(told, names).select(F.col("policy").alias("id"), F.col("regions").alias("__r"), "scope", "rules", F.col("issues").alias("__i"))
    rows = rows.join(regions, "id", "left")
    note = lambda when, path, code: F.when(when, F.concat_ws("|", F.lit(f"$.{path}"), code, F.lit("warning")))
    noted = F.array_compact(
        F.array(
            note(F.col("__c.unmapped"), "category_text", F.lit("unmapped_category")),
            note(F.col("__p.issue").isNotNull(), "application_period_text", F.col("__p.issue")),
            note(F.col("__a.issue").isNotNull(), "age_condition_text", F.col("__a.issue")),
        )
    )
    noted = F.concat(noted, F.transform(F.array_distinct(F.coalesce("__i", none)), lambda i: F.concat_ws("|", F.lit("$.region_text"), i, F.lit("warning"))))
    row = rows.select(
        "id", "source_id", "source_name", "external_id", "title", "organization", "summary", "category_text", F.col("__c.categories").alias("categories"), *LISTS, F.col("application_period_text").alias("period_text"),
        F.col("__p.start").alias("application_start"), F.col("__p.end").alias("application_end"), F.col("__p.schedule").alias("schedule"), F.col("__p.status").alias("status"), "region_text",
        F.when(whole, F.array(F.lit(normalize.NATIONWIDE))).otherwise(F.coalesce("__r", none)).alias("regions"), F.when(whole, "nationwide").otherwise(F.coalesce("scope", F.lit("unknown"))).alias("scope"), F.when(whole, none).otherwise(F.coalesce("rules", none)).alias("region_rules"),
        F.col("__a.low").alias("age_min"), F.col("__a.high").alias("age_max"), F.col("age_condition_text").alias("age_text"), "eligibility_text", "eligibility_summary", "support_content", "application_method", *[none.alias(c) for c in EMPTY], "source_url", "collected_at", "provenance", noted.alias("__noted"),
    )
    judged = validate.validated(row, required, noted="__noted").withColumns({"schema_version": F.lit(VERSION), "data_quality_status": F.col("class")})
    renamed = {"application_period_text": "period_text", "application_schedule": "schedule", "application_status": "status", "coverage_scope": "scope", "age_condition_text": "age_text"}
    return judged.select("id", *[F.col(renamed.get(f, f)).alias(f) for f in FIELDS], "issues")


def public_records(rows: DataFrame, rules: DataFrame, checks: dict[str, Column] | None = None) -> DataFrame:
    """rows of the table (id and FIELDS but region_rules) and rules (policy, pos, and what a rule has) as public records: (id,
    record: JSON of FIELDS in the order of their names, of the contract's version, faults). A version that can't be read, or a
    check that fails, is a fault, and the row has no record then. The quality is judged anew."""
    own = F.sort_array(F.collect_list(F.struct("pos", F.struct(*[c for c in rules.columns if c not in ("policy", "pos")]).alias("rule"))))
    per = rules.groupBy(F.col("policy").alias("id")).agg(F.transform(own, lambda x: x["rule"]).alias("region_rules"))
    all_ = rows.drop("region_rules").join(per, "id", "left")
    asked = {"period_text": "application_period_text", "schedule": "application_schedule", "status": "application_status", "scope": "coverage_scope", "age_text": "age_condition_text"}
    judged = validate.validated(all_.withColumns({a: F.col(b) for a, b in asked.items()}).withColumn("__version", F.col("schema_version")))
    record = F.to_json(F.struct(*[(F.lit(VERSION) if f == "schema_version" else F.col("class") if f == "data_quality_status" else F.coalesce("region_rules", F.array().cast(dict(per.dtypes)["region_rules"])) if f == "region_rules" else F.col(f)).alias(f) for f in sorted(FIELDS) if f in judged.columns or f == "region_rules"]), {"ignoreNullFields": "false"})
    faults = F.array_compact(F.array(F.when(~F.coalesce(F.col("__version").isin(*READABLE), F.lit(False)), "unsupported_schema_version"), F.when(F.col("class") == "invalid", "invalid"), *[F.when(~F.coalesce(c, F.lit(False)), n) for n, c in (checks or {}).items()]))
    return judged.withColumn("faults", faults).select("id", F.when(F.size("faults") == 0, record).alias("record"), "faults")
