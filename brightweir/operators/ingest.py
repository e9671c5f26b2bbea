"""From raw documents to a published table: selection, extraction, import checks, builds, manifests."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brightweir.operators.audit import first_of_each


# Selection ------------------------------------------------------------------------------------------------------------
def latest_batch(documents: DataFrame) -> DataFrame:
    """Documents of each source's latest list response: that response, its items, and the newest detail of each item that isn't
    older than it."""
    lists = first_of_each(documents.where("document_role = 'list_response'"), ["source_id"], [F.col("collected_at").desc(), F.col("document_id").desc()]).drop("place")
    head = lists.select("source_id", F.col("document_id").alias("parent_document_id"), F.col("collected_at").alias("since"))
    items = documents.where("document_role = 'list_item'").join(head.drop("since"), ["source_id", "parent_document_id"], "left_semi")
    return lists.unionByName(items).unionByName(recent_details(items.join(head.drop("parent_document_id"), "source_id"), documents))


def recent_details(items: DataFrame, documents: DataFrame) -> DataFrame:
    """items (source_id, external_id, since): the newest detail of each that was collected since then."""
    own = items.select("source_id", "external_id", "since").distinct()
    details = documents.where("document_role = 'detail_response'").join(own, ["source_id", "external_id"]).where("collected_at >= since").drop("since")
    return first_of_each(details, ["source_id", "external_id"], [F.col("collected_at").desc(), F.col("document_id").desc()]).drop("place").select(*documents.columns)


def chosen_batch(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents of the identities of a checkpoint: ids (source_id, external_id)."""
    return documents.join(ids, ["source_id", "external_id"], "left_semi")


def manifest_batch(documents: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents that a manifest (source_id, document_ids) names, blockers: ids that aren't there or are named twice)."""
    named = manifest.select("source_id", F.explode("document_ids").alias("document_id"))
    twice = named.groupBy("source_id", "document_id").count().where("count > 1").select("document_id", F.lit("named_twice").alias("blocker"))
    lost = named.join(documents, ["source_id", "document_id"], "left_anti").select("document_id", F.lit("not_there").alias("blocker"))
    return documents.join(named, ["source_id", "document_id"], "left_semi"), twice.unionByName(lost.distinct())


def joined_captures(parents: DataFrame, items: DataFrame, details: DataFrame) -> tuple[DataFrame, DataFrame]:
    """parents (document_id), items (parent_document_id, external_id, title), details (external_id, title, ...): (items with
    their detail, faults: orphans, identities that are there twice, titles that drifted)."""
    key = ["external_id"]
    orphan = items.join(parents.select(F.col("document_id").alias("parent_document_id")), "parent_document_id", "left_anti").select("external_id", F.lit("orphan_item").alias("fault"))
    lone = details.join(items, key, "left_anti").select("external_id", F.lit("orphan_detail").alias("fault"))
    twice = items.groupBy(*key).count().where("count > 1").select("external_id", F.lit("duplicate_identity").alias("fault"))
    pairs = items.select("external_id", F.col("title").alias("item_title")).join(details, key)
    clean = lambda c: F.regexp_replace(F.col(c), r"(?U)\s+", "")
    drift = pairs.where(~clean("item_title").eqNullSafe(clean("title"))).select("external_id", F.lit("title_drift").alias("fault"))
    faults = orphan.unionByName(lone).unionByName(twice).unionByName(drift).distinct()
    return pairs.join(faults, key, "left_anti").drop("item_title"), faults


def best_links(links: DataFrame, pages: DataFrame, keywords: list[str]) -> DataFrame:
    """links (page, text, target), pages (page): for each page the link to a known page of the same host with the longest keyword in
    its text, then by text and target."""
    host = lambda c: F.regexp_extract(F.col(c), r"^[a-z]+://([^/?#]+)", 1)
    known = links.join(pages.select(F.col("page").alias("target")).distinct(), "target", "left_semi").where(host("page") == host("target"))
    score = F.greatest(F.lit(0), *[F.when(F.col("text").contains(k), len(k)).otherwise(0) for k in keywords])
    scored = known.withColumn("score", score).where("score > 0")
    return first_of_each(scored, ["page"], [F.col("score").desc(), F.col("text"), F.col("target")]).select("page", "text", "target", "score")


def prioritised(items: DataFrame, score: Column, offset: int, limit: int) -> DataFrame:
    """A source's items by a score, then their position; a stretch of them."""
    place = F.row_number().over(Window.partitionBy("source_id").orderBy(score.desc(), "position"))
    return items.withColumn("place", place).where(F.col("place").between(offset + 1, offset + limit))


# Import ---------------------------------------------------------------------------------------------------------------
def identity_issue(source: Column, external: Column, required: tuple[str, ...]) -> Column:
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return F.when(blank(source), "missing_source_id").when(blank(external), F.when(source.isin(*required), "missing_external_id").otherwise("unsupported_null_external_id"))


def import_counts(outcomes: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """One row: how many rows of each kind, and of all. outcomes (outcome)."""
    return outcomes.agg(*[F.count_if(F.col("outcome") == k).alias(k) for k in kinds], F.count(F.lit(1)).alias("total"))


def run_counters(replay: DataFrame, imported: DataFrame, key: str) -> DataFrame:
    """Counters of the replay and the import of a run side by side; what a side lacks counts as zero."""
    both = replay.join(imported, key, "full")
    return both.select(key, *[F.coalesce(c, F.lit(0)).alias(c) for c in [*replay.columns, *imported.columns] if c != key])


def aligned(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of two tables by position; a position that only one side has is a fault."""
    return left.withColumn("__l", F.lit(True)).join(right.withColumn("__r", F.lit(True)), key, "full").withColumn("aligned", F.col("__l").isNotNull() & F.col("__r").isNotNull()).drop("__l", "__r")


def write_row(programs: DataFrame, now: Column) -> DataFrame:
    """Programs as the table holds them: typed days, the instant of writing, no end of life."""
    day = lambda c: F.col(c).try_cast("date").alias(c)
    rest = [c for c in programs.columns if c not in ("application_start", "application_end")]
    return programs.select(*rest, day("application_start"), day("application_end"), now.alias("created_at"), now.alias("updated_at"), F.lit(None).cast("timestamp").alias("inactive_at"))


def upgraded(programs: DataFrame, current: str, defaults: dict[str, dict[str, Column]]) -> DataFrame:
    """Rows of older contract versions with the defaults of the columns that these lack; other versions are an error in
    column fault. defaults: by version, what to fill in."""
    fill = {c for own in defaults.values() for c in own}
    kinds = dict(programs.dtypes)
    out = programs
    for c in sorted(fill):
        value = F.col(c) if c in kinds else F.lit(None)
        for version, own in defaults.items():
            if c in own:
                value = F.when(F.col("schema_version") == version, own[c]).otherwise(value)
        out = out.withColumn(c, value)
    known = F.col("schema_version").isin(current, *defaults)
    return out.withColumn("fault", F.when(~F.coalesce(known, F.lit(False)), "unsupported_schema_version")).withColumn("schema_version", F.when(known, current).otherwise(F.col("schema_version")))


def read_columns(policies: DataFrame, hidden: tuple[str, ...]) -> DataFrame:
    return policies.drop(*hidden)


def by_id(policies: DataFrame, key: int, visible: Column | None = None) -> DataFrame:
    """A point lookup, under the rules of visibility or, for the administration, without."""
    rows = policies.where(F.col("id") == key)
    return rows if visible is None else rows.where(visible)


def run_filter(source: str | None = None, status: tuple[str, ...] = (), kind: str | None = None, since: str | None = None, until: str | None = None) -> Column:
    """Runs of a source, of states, of a kind, started within days."""
    tests = [F.lit(True)]
    tests += [F.col("source") == source] if source else []
    tests += [F.col("status").isin(*status)] if status else []
    tests += [F.col("type") == kind] if kind else []
    tests += [F.col("started") >= F.lit(since).cast("timestamp_ntz")] if since else []
    tests += [F.col("started") < F.date_add(F.lit(until).cast("date"), 1)] if until else []
    return functools.reduce(Column.__and__, tests)


def approved(url: Column, patterns: list[str]) -> Column:
    """Whether an https address without credentials has an approved one's host and path, and all of its query pairs."""
    whole = r"^([a-z]+)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
    part = lambda k: F.regexp_extract(url, whole, k)
    pairs = F.split(part(4), "&")

    def fits(p: str) -> Column:
        from urllib.parse import urlsplit

        u = urlsplit(p)
        same = (part(2) == u.netloc) & (part(3) == u.path)
        return functools.reduce(Column.__and__, [F.array_contains(pairs, q) for q in u.query.split("&") if q], same)

    return F.coalesce((part(1) == "https") & ~part(2).contains("@") & functools.reduce(Column.__or__, map(fits, patterns)), F.lit(False))


def baseline(policies: DataFrame, snapshots: DataFrame, sources: tuple[str, ...], active: Column) -> tuple[DataFrame, DataFrame]:
    """(rows of approved sources that are active and not invalid, blockers): a source without rows, a source without a
    snapshot, and rows that are newer than their source's snapshot. snapshots (source_id, completed_at)."""
    own = policies.where(F.col("source_id").isin(*sources) & (F.col("quality") != "invalid") & active)
    said = own.join(snapshots, "source_id", "left").groupBy("source_id").agg(F.count_if(F.col("completed_at").isNull()).alias("bare"), F.count_if(F.col("collected_at") > F.col("completed_at")).alias("newer"))
    every = policies.sparkSession.createDataFrame([(s,) for s in sources], "source_id string").join(said, "source_id", "left")
    fault = F.when(F.col("bare").isNull(), "no_rows").when(F.col("bare") > 0, "no_snapshot").when(F.col("newer") > 0, "newer_than_snapshot")
    return own, every.select("source_id", fault.alias("blocker")).where("blocker IS NOT NULL")


# Checkpoints ----------------------------------------------------------------------------------------------------------
#: From which states a checkpoint's identity may go where.
STEPS = {"discover": (None, "discovered"), "capture": ("discovered", "captured"), "amend": ("captured", "captured"), "decide": ("captured", "decided"), "redecide": ("decided", "decided")}


def advanced(checkpoint: DataFrame, step: str, ids: DataFrame, outcome: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """checkpoint (source_id, external_id, state, outcome) after a step for some identities (ids has these columns and what
    ``outcome`` needs), and the identities that the step is refused for."""
    before, after = STEPS[step]
    key = ["source_id", "external_id"]
    new = ids.select(*key, (outcome if outcome is not None else F.lit(None).cast("string")).alias("__outcome")).dropDuplicates(key).withColumn("__asked", F.lit(True))
    both = checkpoint.join(new, key, "full")
    fine = F.col("__asked").isNotNull() & F.col("state").eqNullSafe(F.lit(before))
    refused = both.where(F.col("__asked").isNotNull() & ~fine).select(*key)
    out = both.where(F.col("state").isNotNull() | fine).select(*key, F.when(fine, after).otherwise(F.col("state")).alias("state"), F.when(fine & F.col("__outcome").isNotNull(), F.col("__outcome")).otherwise(F.col("outcome")).alias("outcome"))
    return out, refused


def complete(checkpoint: DataFrame) -> DataFrame:
    """By source: identities, how many are decided, and whether all are and none has failed."""
    per = checkpoint.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("state") == "decided").alias("decided"), F.count_if(F.col("outcome") == "failed").alias("failed"))
    return per.withColumn("complete", (F.col("n") == F.col("decided")) & (F.col("failed") == 0))


def failures(decisions: DataFrame, source: str, page_size: int = 12) -> DataFrame:
    """decisions (source_id, external_id, position, outcome): failed ones, classified where the source's list went past its first page."""
    told = F.coalesce((F.col("source_id") == source) & (F.col("position") >= page_size), F.lit(False))
    return decisions.where("outcome = 'failed'").select("source_id", "external_id", F.when(told, "detail_click_or_post_contract").otherwise("unclassified").alias("kind"), F.when(told, F.floor(F.col("position") / page_size) + 1).alias("page"))


def same_actions(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """a and b (key, position, kind, target): keys whose ordered actions differ."""
    text = lambda df, n: df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("position", "kind", "target"))).alias(n))
    return text(a, "x").join(text(b, "y"), key, "full").where(~F.col("x").eqNullSafe(F.col("y"))).select(key)


# Regions --------------------------------------------------------------------------------------------------------------
def built_regions(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (code, full_name, lowest_name, parent_code, status): (regions with level and aggregate parent, blockers).

    Codes that end in 00000 are kept. The aggregate parent of an active region whose name has three words or more is the
    active region under the same parent whose full name is its own without the last word."""
    own = rows.where(F.col("code").endswith("00000"))
    words = F.split("full_name", " ")
    above = F.array_join(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(1))), " ")
    active = own.where("status = 'active'").select(F.col("parent_code").alias("p"), F.col("full_name").alias("f"), F.col("code").alias("c"))
    found = active.groupBy("p", "f").agg(F.min("c").alias("aggregate_parent"), F.count(F.lit(1)).alias("n"))
    asks = (F.col("status") == "active") & (F.size(words) >= 3)
    out = own.withColumn("above", F.when(asks, above)).join(found, (F.col("above") == F.col("f")) & F.coalesce("parent_code", F.lit("")).eqNullSafe(F.coalesce("p", F.lit(""))), "left")
    parents = own.select(F.col("code").alias("parent_code"))
    orphan = own.where("parent_code <> '0000000000' OR (parent_code IS NULL AND status <> 'retired')").join(parents, "parent_code", "left_anti").select("code", F.lit("orphan").alias("blocker"))
    unsure = out.where("n > 1").select("code", F.lit("ambiguous_aggregate_parent").alias("blocker"))
    return out.select("code", "full_name", F.col("lowest_name").alias("name"), "parent_code", "aggregate_parent", "status"), orphan.unionByName(unsure)


def aliases(regions: DataFrame, curated: DataFrame) -> DataFrame:
    """(alias, code): full names, short names and curated ones, each once."""
    full = regions.select(F.col("full_name").alias("alias"), "code")
    return full.unionByName(regions.select(F.col("name").alias("alias"), "code")).unionByName(curated.select("alias", "code")).where("alias IS NOT NULL").distinct()


# Tables and releases --------------------------------------------------------------------------------------------------
def table_counts(spark: SparkSession, tables: dict[str, DataFrame], allowed: tuple[str, ...]) -> DataFrame:
    """(name, n) of all tables; names that are not on the list, or are missing from it, are an error."""
    if set(tables) != set(allowed):
        raise ValueError(f"tables differ from the list: {sorted(set(tables) ^ set(allowed))}")
    each = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n") for n, df in sorted(tables.items())]
    return functools.reduce(DataFrame.unionByName, each)


def release_rows(programs: DataFrame, sources: tuple[str, ...], unsafe: Column, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of allowed sources that are safe, blockers by key: sources that aren't allowed, unsafe rows, keys that are there twice)."""
    named = F.concat_ws("/", *key).alias("key")
    other = programs.where(~F.col("source_id").isin(*sources)).select(named, F.lit("source_not_allowed").alias("blocker"))
    bad = programs.where(unsafe).select(named, F.lit("unsafe").alias("blocker"))
    twice = programs.groupBy(*key).count().where("count > 1").select(named, F.lit("repeated").alias("blocker"))
    return programs.where(F.col("source_id").isin(*sources) & ~unsafe), other.unionByName(bad).unionByName(twice)


def write_once(df: DataFrame, root: str, name: str) -> str:
    """Writes a manifest under its content's hash; one that is there already, and so is equal, is left alone."""
    from brightweir.operators.release import tree

    top = tree(df, df.columns).where("level = 0").first()
    path = f"{root}/{name}-{top['sha256'] if top else 'empty'}"
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        df.write.mode("overwrite").json(path)
    return path


def safety_report(programs: DataFrame, consistent: Column, cohort: Column) -> DataFrame:
    """One row: rows of a cohort, how many are consistent, and whether all are."""
    return programs.agg(F.count_if(cohort).alias("cohort"), F.count_if(cohort & consistent).alias("consistent"), F.count_if(cohort & ~consistent).alias("inconsistent")).withColumn("passed", F.col("inconsistent") == 0)


def unknown_counts(items: DataFrame) -> DataFrame:
    """items (unknown_conditions, reasons: arrays): how many have an open condition, and how many an unconfirmed region."""
    return items.agg(F.count_if(F.size("unknown_conditions") > 0).alias("unknown_items"), F.count_if(F.array_contains("reasons", "REGION_UNCONFIRMED")).alias("unconfirmed_regions"))


def typed_profile(records: DataFrame, source: str, field: str, value: str) -> DataFrame:
    """records (source, document, field, value as JSON text): by source and field the documents that have it, that lack it and
    that have it empty, rates, and the sorted names of its JSON types."""
    from brightweir.functions.wording import json_type

    of = records.groupBy(source).agg(F.count_distinct("document").alias("documents"))
    empty = F.col(value).isin("null", '""', "[]")
    per = records.groupBy(source, field).agg(F.count_distinct("document").alias("present"), F.count_if(empty).alias("empty"), F.array_join(F.array_sort(F.collect_set(json_type(F.parse_json(value)))), ",").alias("types"))
    out = per.join(of, source)
    return out.select(source, field, "present", (F.col("documents") - F.col("present")).alias("missing"), "empty", (F.col("present") - F.col("empty")).alias("non_empty"), (F.col("present") / F.col("documents")).alias("presence_rate"), (F.col("empty") / F.col("documents")).alias("empty_rate"), "types")


def favourites(events: DataFrame, most: int) -> DataFrame:
    """events (user, item, at): each user's different items in order of their first time, at most so many."""
    first = events.groupBy("user", "item").agg(F.min("at").alias("at"))
    return first_of_each(first, ["user"], [F.col("at"), F.col("item")], most).select("user", "item", "place")
