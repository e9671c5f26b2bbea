"""Gates before a table is changed or published: each returns rows that say what stands in the way, none if nothing does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightweir.operators.audit import first_of_each


def _said(key: Column, *faults: tuple[Column, str]) -> Column:
    return F.explode(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(key.alias("key"), F.lit(n).alias("blocker"))) for c, n in faults])))


def snapshot_blockers(pages: DataFrame, items: DataFrame, budget: int) -> DataFrame:
    """pages (source, page, page_size, total, requests), items (source, page, id): (key, blocker) for each source whose pages
    don't prove a complete snapshot: totals that change, items that repeat, more or fewer items than reported, a short page
    before the last, pages that are missing, more requests than allowed."""
    per_page = items.groupBy("source", "page").agg(F.count(F.lit(1)).alias("n"))
    p = pages.join(per_page, ["source", "page"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    p = p.groupBy("source").agg(
        F.count_distinct("total").alias("totals"), F.max("total").alias("total"), F.count(F.lit(1)).alias("pages"), F.max("page").alias("last"),
        F.sum("requests").alias("requests"), F.count_if(F.col("total").isNull()).alias("unknown"), F.sum("n").alias("n"),
        F.max(F.when(F.col("n") < F.col("page_size"), F.struct((-F.col("page")).alias("neg"))))["neg"].alias("short"),
    )
    distinct = items.groupBy("source").agg(F.count_distinct("id").alias("ids"))
    p = p.join(distinct, "source", "left").withColumn("ids", F.coalesce("ids", F.lit(0)))
    said = _said(
        F.col("source"),
        (F.col("unknown") > 0, "total_missing"),
        (F.col("totals") > 1, "total_changed"),
        (F.col("ids") < F.col("n"), "item_repeated"),
        (F.col("ids") > F.col("total"), "more_items_than_total"),
        (F.col("ids") < F.col("total"), "fewer_items_than_total"),
        (-F.col("short") < F.col("last"), "short_page_before_last"),
        (F.col("pages") != F.col("last"), "page_missing"),
        (F.col("requests") > budget, "budget_exceeded"),
    )
    return p.select(said.alias("s")).select("s.*")


def pagination_blockers(pages: DataFrame, safety_max: int) -> DataFrame:
    """pages (source, page, n, page_size, total, has_next): what is wrong with the way a listing ends."""
    said = _said(
        F.col("source"),
        ((F.col("page") > safety_max) | (F.col("has_next") & (F.col("page") == safety_max)), "safety_limit"),
        (F.col("n") < 1, "page_empty"),
        (F.col("n") > F.col("page_size"), "page_size_drifted"),
        (F.col("total").isNull(), "total_missing"),
        (~F.col("has_next") & (F.col("n") > F.col("total")), "total_drifted"),
    )
    return pages.select(said.alias("s")).select("s.*").distinct()


def promotion_blockers(runs: DataFrame, chosen: DataFrame, sources: DataFrame) -> DataFrame:
    """runs (run, source, type, status, started, finished, complete, failures), chosen (run), sources (source): (key, blocker)
    where the chosen runs are not, for each source, just the latest collection, succeeded, complete and without failures."""
    own = chosen.groupBy("run").agg(F.count(F.lit(1)).alias("times")).join(runs, "run", "left")
    latest = first_of_each(runs.where("type = 'collection'"), ["source"], [F.col("started").desc(), F.col("run").desc()]).select("source", F.col("run").alias("latest"))
    per = own.where("source IS NOT NULL").groupBy("source").agg(F.count(F.lit(1)).alias("runs"))
    rows = own.join(latest, "source", "left").join(per, "source", "left")
    bad = rows.select(
        _said(
            F.coalesce("source", F.col("run").cast("string")),
            (F.col("source").isNull(), "run_not_found"),
            (F.col("times") > 1, "run_repeated"),
            (F.col("runs") > 1, "several_runs"),
            (F.col("source").isNotNull() & ~F.col("run").eqNullSafe(F.col("latest")), "not_latest"),
            ((F.col("type") != "collection") | (F.col("status") != "succeeded"), "not_succeeded"),
            (~F.col("complete"), "not_complete"),
            (F.col("source").isNotNull() & (F.col("finished").isNull() | (F.col("failures") != 0)), "has_failures"),
        ).alias("s")
    ).select("s.*")
    lost = sources.join(per, "source", "left_anti").select(F.col("source").alias("key"), F.lit("no_run").alias("blocker"))
    extra = per.join(sources, "source", "left_anti").select(F.col("source").alias("key"), F.lit("unknown_source").alias("blocker"))
    return bad.unionByName(lost).unionByName(extra)


def lifecycle_complete(complete: Column, invalid: Column, committed: Column, skipped: Column, rejected: Column, failed: Column) -> Column:
    """Whether a run proves which policies are gone, so that a soft delete may follow."""
    zero = lambda c: F.coalesce(c, F.lit(0)) == 0
    return F.coalesce(complete & committed, F.lit(False)) & zero(invalid) & zero(skipped) & zero(rejected) & zero(failed)


def stale(status: Column, started: Column, finished: Column, now: Column, seconds: int = 7200) -> Column:
    """Queued or running, not finished, and started ``seconds`` ago or longer."""
    return F.coalesce(status.isin("queued", "running") & finished.isNull() & (elapsed(started, now) >= seconds), F.lit(False))


def elapsed(started: Column, now: Column) -> Column:
    return F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(started.cast("timestamp"))


#: From which states a run may go where.
RUN_STEPS = {"start": (None, "running"), "enqueue": (None, "queued"), "claim": ("queued", "running"), "succeed": ("running", "succeeded"), "fail": ("running", "failed")}


def run_log(events: DataFrame) -> DataFrame:
    """events (run, seq, step): the state of each run after its events in order, and whether every step was allowed."""
    before = F.create_map(*[F.lit(x) for s, (a, _) in RUN_STEPS.items() for x in (s, a or "none")])
    after = F.create_map(*[F.lit(x) for s, (_, b) in RUN_STEPS.items() for x in (s, b)])
    steps = F.transform(F.array_sort(F.collect_list(F.struct("seq", "step"))), lambda x: x["step"])
    start = F.struct(F.lit("none").alias("state"), F.lit(True).alias("allowed"))
    walk = lambda acc, s: F.struct(F.coalesce(after[s], acc["state"]).alias("state"), (acc["allowed"] & F.coalesce(before[s] == acc["state"], F.lit(False))).alias("allowed"))
    return events.groupBy("run").agg(steps.alias("steps")).select("run", F.aggregate("steps", start, walk).alias("r")).select("run", "r.state", "r.allowed")


def reference_changes(stored: DataFrame, incoming: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, change): insert, or changed and unexpected, which an insert-only import refuses. Equal rows don't show."""
    a, b = stored.select(*keys, F.struct(*values).alias("a")), incoming.select(*keys, F.struct(*values).alias("b"))
    both = a.join(b, keys, "full")
    change = F.when(F.col("a").isNull(), "insert").when(F.col("b").isNull(), "unexpected").when(F.col("a") != F.col("b"), "changed")
    return both.select(*keys, change.alias("change")).where("change IS NOT NULL")


def changed_children(current: DataFrame, fresh: DataFrame, parent: str, cols: list[str]) -> DataFrame:
    """Parents whose multisets of child rows differ, so that only their children are written again."""
    text = lambda df, n: df.groupBy(parent).agg(F.array_sort(F.collect_list(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in cols]))).alias(n))
    both = text(current, "a").join(text(fresh, "b"), parent, "full")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select(parent)


def field_states(slots: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """slots (field, state): counts of each state, and whether they add up to all slots of the field."""
    counts = [F.count_if(F.col("state") == k).alias(k) for k in kinds]
    out = slots.groupBy("field").agg(F.count(F.lit(1)).alias("slots"), *counts)
    return out.withColumn("reconciled", sum((F.col(k) for k in kinds), F.lit(0)) == F.col("slots"))


def criteria(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row: all criteria by name as booleans, and the names of those that fail, in order."""
    one = df.agg(*[F.coalesce(F.bool_and(c), F.lit(True)).alias(n) for n, c in checks.items()])
    return one.withColumn("blockers", F.array_join(F.array_compact(F.array(*[F.when(~F.col(n), n) for n in checks])), ","))
