"""Evidence behind decisions: supplemental sources, observations, territories, reviews in two rounds, replays, acceptance runs."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightweir.functions.text import canonical_url, comparable
from brightweir.functions.wording import fingerprint
from brightweir.operators import program
from brightweir.operators.audit import met
from brightweir.operators.decide import admission, duplicate_decisions
from brightweir.session import cut

#: What a supplemental policy must have confirmed, in the order in which it is asked for.
REQUIRED = ("youth_target", "organization", "eligibility", "required_documents", "application_method")


def supplemental(availability: Column, evidence: Column) -> tuple[Column, Column]:
    """(outcome, reasons) of a supplemental policy: availability open, closed or anything else; evidence a map of REQUIRED and
    application_availability to states, of which 'confirmed' counts."""
    names = F.array_sort(F.array(*map(F.lit, (*REQUIRED, "application_availability"))))
    drift = ~F.array_sort(F.map_keys(evidence)).eqNullSafe(names)
    missing = F.array_compact(F.array(*[F.when(~F.coalesce(evidence[n] == "confirmed", F.lit(False)), f"{n}_unconfirmed") for n in REQUIRED]))
    outcome = (
        F.when(evidence.isNull() | drift, "failed")
        .when(availability == "closed", "closed")
        .when(F.coalesce(availability != "open", F.lit(True)) | (F.size(missing) > 0), "review")
        .otherwise("accepted")
    )
    reason = (
        F.when(evidence.isNull(), "evidence_contract_missing")
        .when(drift, "evidence_contract_drift")
        .when(availability == "closed", "application_closed")
        .when(F.coalesce(availability != "open", F.lit(True)), "application_availability_unconfirmed")
        .when(F.size(missing) > 0, F.array_join(missing, "+"))
        .otherwise("minimum_official_evidence_confirmed")
    )
    return outcome, reason


def inventory_duplicates(candidates: DataFrame, baseline: DataFrame) -> DataFrame:
    """candidates (id, status, direct, url, title_key), baseline (id, title_key, url): (id, outcome, reason). direct is the id that a
    candidate of an approved aggregator states; others are compared by address, then by title. Each side is brought down to a
    row a key first."""
    by = lambda c, n: baseline.where(F.col(c).isNotNull()).groupBy(F.col(c).alias(f"__{n}")).agg(F.count(F.lit(1)).alias(n), F.first("title_key").alias(f"{n}_title"))
    out = candidates
    for col, on, name in (("direct", "id", "same_id"), ("url", "url", "same_url"), ("title_key", "title_key", "same_title")):
        out = out.join(by(on, name), F.col(col) == F.col(f"__{name}"), "left").drop(f"__{name}")
    kinds = (
        F.when(F.col("direct").isNotNull() & F.col("same_id").isNotNull(), F.when(F.col("title_key").eqNullSafe(F.col("same_id_title")), "exact_duplicate/aggregator_external_id_match").otherwise("exact_duplicate/aggregator_external_id_match+title_conflict"))
        .when(F.col("direct").isNotNull(), "review_required/direct_id_missing_from_baseline")
        .when(F.col("status") != "candidate", F.concat(F.lit("not_assessed/"), "status"))
        .when(F.col("same_url").isNotNull(), "exact_duplicate/canonical_url_match")
        .when(F.col("same_title").isNotNull(), "review_required/normalized_title_match_only")
        .otherwise("potentially_new/no_exact_id_url_or_title_match")
    )
    p = F.split(kinds, "/", 2)
    return out.select("id", p[0].alias("outcome"), p[1].alias("reason"))


def observation_faults(observations: Column, values: Column, fields: list[str]) -> Column:
    """observations: map of a field to a struct (status, label), values: map of a field to its value; the fields whose observation
    is missing or disagrees with its value or label. A null map is no observation at all, which is allowed."""

    def wrong(f: str) -> Column:
        o, v = observations[f], values[f]
        known = F.coalesce(o["status"].isin("value_extracted", "label_present_value_empty", "label_not_found"), F.lit(False))
        blank = F.coalesce(F.trim(o["label"]) == "", F.lit(False))
        return ~known | blank | ((o["status"] == "value_extracted") != v.isNotNull()) | ((o["status"] == "label_not_found") != o["label"].isNull())

    own = F.array_compact(F.array(*[F.when(F.coalesce(wrong(f), F.lit(True)), f) for f in fields]))
    extra = F.size(F.array_except(F.map_keys(observations), F.array(*map(F.lit, fields)))) > 0
    return F.when(observations.isNull(), F.array().cast("array<string>")).when(extra, F.concat(own, F.array(F.lit("unknown_field")))).otherwise(own)


def scope_faults(fields: list[str], locators: Column) -> Column:
    """What is wrong with a source scope's columns: a value that isn't trimmed, and values and locators (a map) that don't go
    together."""
    odd = [F.when(F.col(f) != F.trim(f), f"{f}:text") for f in fields] + [F.when((F.trim(f) == "") & F.col(f).isNotNull(), f"{f}:blank") for f in fields]
    pair = [F.when(F.col(f).isNotNull() != F.coalesce(locators[f].isNotNull(), F.lit(False)), f"{f}:locator") for f in fields]
    extra = F.when(F.size(F.array_except(F.map_keys(locators), F.array(*map(F.lit, fields)))) > 0, "locator:unknown")
    return F.array_compact(F.array(*odd, *pair, extra))


def territory(tree: DataFrame, aliases: DataFrame, code: str) -> tuple[DataFrame, DataFrame]:
    """(codes, aliases) under a jurisdiction, itself included: an alias counts if it leads to one code, which is one of them.
    tree from ``verdict.closure``; aliases (alias, code)."""
    codes = tree.where(F.col("ancestor") == code).select("code").distinct()
    alone = aliases.distinct().groupBy("alias").agg(F.min("code").alias("code"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    return codes, alone.join(codes, "code", "left_semi").select("alias")


def review(candidates: DataFrame, normalized: DataFrame, duplicates: DataFrame) -> DataFrame:
    """A review in two rounds: candidates that fail before normalisation keep that decision; the others are decided again with
    what normalisation (id, normalization, fingerprint) and the duplicate check (id, duplicate) say. (id, outcome, reason, round)."""
    probe = {"normalization": "valid", "fingerprint": "sha256:probe", "duplicate": "accepted_regional"}
    outcome, reason = admission()
    first = candidates.withColumns({c: F.lit(v) for c, v in probe.items()}).withColumns({"first_outcome": outcome, "first_reason": reason}).drop(*probe)
    both = first.join(normalized, "id", "left").join(duplicates, "id", "left").withColumn("normalization", F.coalesce("normalization", F.lit("missing")))
    again = both.withColumns({"outcome": outcome, "reason": reason})
    passed = F.col("first_outcome") == "promote_partial"
    return again.select("id", F.when(passed, F.col("outcome")).otherwise(F.col("first_outcome")).alias("outcome"), F.when(passed, F.col("reason")).otherwise(F.col("first_reason")).alias("reason"), F.when(passed, 2).otherwise(1).alias("round"))


#: What a decision reads, in the order in which its fingerprint names it.
READ = ("identity_valid", "checkpoint", "application", "markers", "original", "current", "normalization", "fingerprint", "duplicate")


def reviewed(candidates: DataFrame, extracted: DataFrame, names: DataFrame, baseline: DataFrame | None, required: tuple[str, ...] = ("source_id", "external_id", "title")) -> DataFrame:
    """A review to its end, in one plan: (id, outcome, reason, round, input). candidates have what ``decide.admission`` reads of the
    checkpoint; extracted (id, ...) are their policies; names and baseline as in ``program.normalized`` and
    ``decide.duplicate_decisions``.

    The first round decides as if all that follows went well. Those that pass are normalised and decided again (round 2) with the
    class and content they have; those that pass once more meet the baseline and each other (round 3): of equal contents the
    one with the least id stands. input is a hash of what the round's decision read."""
    outcome, reason = admission()
    said = F.sha2(F.to_json(F.struct(*READ), {"ignoreNullFields": "false"}), 256)

    def decided(rows: DataFrame, number: int) -> DataFrame:
        return cut(rows.withColumns({"outcome": outcome, "reason": reason, "input": said, "round": F.lit(number)}))

    on = F.col("outcome") == "promote_partial"
    probe = {"normalization": "partial", "fingerprint": "sha256:probe", "duplicate": "accepted_regional"}
    own = candidates.select("id", *READ[:6])
    first = decided(own.withColumns({c: F.lit(v) for c, v in probe.items()}), 1)
    whole = cut(program.normalized(extracted.join(first.where(on).select("id"), "id", "left_semi"), names, required=required))
    content = [c for c in program.FIELDS if c not in ("source_id", "source_name", "external_id", "source_url", "collected_at", "provenance")]
    made = whole.select("id", F.col("data_quality_status").alias("normalization"), fingerprint({c: F.col(c) for c in content}).alias("fingerprint"))
    second = decided(own.join(first.where(on).select("id"), "id", "left_semi").join(made, "id", "left").withColumns({"normalization": F.coalesce("normalization", F.lit("missing")), "duplicate": F.lit("accepted_regional")}), 2)
    passed = second.where(on).select("id", "normalization", "fingerprint")
    heads = passed.groupBy("fingerprint").agg(F.min("id").alias("__head"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    keyed = whole.join(passed.select("id"), "id", "left_semi").select(
        "id", comparable("title").alias("title_key"), F.coalesce(comparable("organization"), F.lit("")).alias("org_key"), F.coalesce(comparable("support_content"), F.lit("")).alias("support_key"), F.array_sort("regions").alias("region_keys"), "application_start", "application_end",
        F.array_compact(F.array(canonical_url(F.col("source_url")))).alias("urls"), F.array().cast("array<string>").alias("announcements"), F.array().cast("array<string>").alias("references"),
    )
    told = duplicate_decisions(cut(keyed), baseline).select("id", F.col("outcome").alias("duplicate"))
    third = met(passed, heads, "fingerprint").join(told, "id", "left").withColumn("duplicate", F.when(F.col("id") > F.col("__head"), "excluded_intra_batch_duplicate").otherwise(F.col("duplicate"))).drop("__head")
    third = decided(own.join(third, "id"), 3)
    keep = ["id", "outcome", "reason", "round", "input"]
    return first.where(~on).select(*keep).unionByName(second.where(~on).select(*keep)).unionByName(third.select(*keep))


def replay_differs(before: DataFrame, after: DataFrame, key: list[str], cols: list[str]) -> DataFrame:
    """Keys whose decisions, taken again, are others, or are there on one side alone."""
    a, b = before.select(*key, F.struct(*cols).alias("a")), after.select(*key, F.struct(*cols).alias("b"))
    return a.join(b, key, "full").where(~F.col("a").eqNullSafe(F.col("b"))).select(*key)


def acceptance(results: DataFrame, scenarios: DataFrame) -> DataFrame:
    """scenarios (scenario, expected_id, most_rank, expected: map of column to value), results (scenario, id, rank, verdicts: map):
    (scenario, rank, blockers): the row isn't found, ranks too low, or has other verdicts."""
    found = scenarios.join(results.withColumnRenamed("id", "expected_id"), ["scenario", "expected_id"], "left")
    other = F.array_sort(F.map_keys(F.map_filter("expected", lambda k, v: ~F.col("verdicts")[k].eqNullSafe(v))))
    faults = F.array_compact(F.array(F.when(F.col("rank").isNull(), "not_found"), F.when(F.col("rank") > F.col("most_rank"), "rank"), F.when(F.col("rank").isNotNull() & (F.size(other) > 0), F.concat(F.lit("verdict:"), F.array_join(other, "+")))))
    return found.select("scenario", "rank", F.array_join(faults, ",").alias("blockers"))


def cross_checks(rows: DataFrame, checks: dict[str, Column], key: str) -> DataFrame:
    """(key, failed): rows of an inventory and the names of the checks between their fields that fail."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), n) for n, c in checks.items()]))
    return rows.select(F.col(key).alias("key"), F.array_join(failed, ",").alias("failed")).where("failed <> ''")


def ready(runs: DataFrame, sources: DataFrame) -> DataFrame:
    """One row: whether the latest run of every source has ended well, and how many are still waited for. runs from
    ``first_of_each`` (source, status)."""
    state = sources.join(runs, "source", "left")
    waiting = F.col("status").isNull() | F.col("status").isin("queued", "running")
    return state.agg(F.count_if(waiting).alias("waiting"), F.coalesce(F.bool_and(F.coalesce(F.col("status") == "succeeded", F.lit(False))), F.lit(True)).alias("ready"))


def eligibility(fields: dict[str, tuple[str, ...]], row: Column) -> Column:
    """array<struct<kind, text>> of what a source's fields (a map) say about eligibility, in the order of kinds; blank ones are left out."""
    parts = [F.struct(F.lit(k).alias("kind"), F.nullif(F.concat_ws("\n", *[F.nullif(F.trim(row[n]), F.lit("")) for n in names]), F.lit("")).alias("text")) for k, names in fields.items()]
    return F.filter(F.array(*parts), lambda x: x["text"].isNotNull())


def both_groups(groups: list[DataFrame], totals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Several lists of one source (id, ...) as one, and what is wrong: ids that are there twice, fewer reported (totals: n) than returned."""
    every = functools.reduce(DataFrame.unionByName, groups)
    twice = every.groupBy("id").count().where("count > 1").select(F.col("id").cast("string").alias("key"), F.lit("repeated").alias("blocker"))
    sums = totals.agg(F.sum("n").alias("n")).join(every.agg(F.count(F.lit(1)).alias("m")))  # one row each
    return every, twice.unionByName(sums.where("m > n").select(F.lit("total").alias("key"), F.lit("fewer_reported").alias("blocker")))
