"""A source's progress as a fold over its events: which pages were discovered, what was captured, what was decided.

Events (source, seq, kind, page, ids, total, has_next, outcomes) are in order of seq within a source; every one but the first
refused one takes effect, and nothing after a refused one does. Whether an event is allowed depends on what came before it:
what is known of one identity comes from a window over the identity's own events, what is known of the source from running
sums over its events, which are a row each however many identities they name. No state is collected, so a source with most
of the identities is no large group.

Kinds: discover (the next page), amend (identities missed on the latest page, while there are more), capture, decide, reclaim
(failed ones that were captured go to review or are closed), redecide (all of a complete source). ids belong to the first
three, outcomes (a map) to the others; nulls count as empty. A source without a valid event has no identities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brightweir.operators import versions
from brightweir.session import swept

# Outcomes of a decision, and those that a failed one can be given later.
OUTCOMES = ("accepted", "duplicate", "review", "closed", "failed")
RECLAIMED = ("review", "closed")
ID = r"^[A-Za-z0-9][A-Za-z0-9._:-]{0,127}$"


def _names() -> Column:
    """The identities that an event names, as often as it names them, each with its outcome."""
    return F.when(F.col("kind").isin("discover", "amend", "capture"), F.transform(F.coalesce("ids", F.array().cast("array<string>")), lambda x: F.struct(x.alias("id"), F.lit(None).cast("string").alias("outcome")))).otherwise(
        F.transform(F.map_entries(F.coalesce("outcomes", F.create_map().cast("map<string,string>"))), lambda e: F.struct(e["key"].alias("id"), e["value"].alias("outcome")))
    )


def _mentions(events: DataFrame) -> DataFrame:
    """(source, seq, kind, id, outcome): a row for each identity that an event names, as often as it names it."""
    return events.select("source", "seq", "kind", F.explode(_names()).alias("x")).select("source", "seq", "kind", "x.id", "x.outcome")


def _before(rows: DataFrame, named: Column) -> DataFrame:
    """rows with what came before them for their identity; named: whether a row stands for an identity."""
    before = Window.partitionBy("source", "id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    had = lambda *kinds: F.coalesce(F.max(F.col("kind").isin(*kinds) & named).over(before), F.lit(False))
    decided = F.when(F.col("kind").isin("decide", "reclaim", "redecide"), F.col("outcome"))
    return rows.withColumns({"found": had("discover", "amend"), "captured": had("capture"), "outcome_before": F.last(decided, True).over(before)})


def _named(events: DataFrame) -> DataFrame:
    """``_mentions``, each once, with what came before it. One shuffle and one sort serve both the grouping and the window."""
    rows = _mentions(events).repartition("source", "id").groupBy("source", "id", "seq", "kind").agg(F.max("outcome").alias("outcome"))
    return _before(rows, F.lit(True))


def _counts(named: Column) -> list[Column]:
    """Of an event's rows of ``_before``, what its judgement asks for."""
    n = lambda name, c: F.count_if(named & c).alias(name)
    failed = F.col("outcome") == "failed"
    return [
        F.count_if(named).alias("n"),
        n("new", ~F.col("found")),
        n("again", F.col("captured")),
        n("decided", F.col("outcome_before").isNotNull()),
        n("bare", ~F.coalesce(failed, F.lit(False)) & ~F.col("captured")),
        n("odd", ~F.coalesce(F.col("outcome").isin(*OUTCOMES), F.lit(False))),
        n("unfit", ~F.coalesce(F.col("outcome").isin(*RECLAIMED), F.lit(False))),
        n("lost", F.col("captured") & F.coalesce(F.col("outcome_before") == "failed", F.lit(False))),
        n("misnamed", ~F.coalesce(F.col("id").rlike(ID), F.lit(False))),
    ]


def judged(events: DataFrame) -> DataFrame:
    """events with fault: why an event is refused, given that all before it were not; null if it isn't."""
    per = _named(events).groupBy("source", "seq").agg(*_counts(F.lit(True)))
    # Counted here, so that lists which nobody asks for later need not be shuffled.
    rows = events.withColumn("__told", F.coalesce(F.size("ids"), F.lit(0))).join(per, ["source", "seq"], "left").fillna(0, ["n", "new", "again", "decided", "bare", "odd", "unfit", "lost", "misnamed"])
    return _with_fault(rows).select(*events.columns, "fault", "pages", "known", "new", "n", "ended", "known_total")


def _judged_together(events: DataFrame) -> DataFrame:
    """``judged`` without ids and outcomes, for events that are partitioned by source: nothing is shuffled. A source's events have
    a row each for what they name, and are put together again from these."""
    own = ["seq", "kind", "page", "total", "has_next", "__told"]
    told = events.withColumn("__told", F.coalesce(F.size("ids"), F.lit(0)))
    each = told.select("source", *own, F.explode_outer(F.when(F.col("source").isNotNull(), _names())).alias("x"))
    each = each.select("source", "x.id", *own, F.col("x").isNotNull().alias("__named"), "x.outcome")
    named = F.col("__named")
    rows = _before(each.groupBy("source", "id", *own, "__named").agg(F.max("outcome").alias("outcome")), named)
    return _with_fault(rows.groupBy("source", *own).agg(*_counts(named)))


def _with_fault(rows: DataFrame) -> DataFrame:
    """Events with their counts and __told, the length of their list: with fault, and what came before in their source."""
    kind = F.col("kind")
    rows = rows.withColumn("repeats", F.col("__told") > F.col("n"))
    so_far = Window.partitionBy("source").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    finds = kind.isin("discover", "amend")
    total = lambda c: F.coalesce(F.sum(c).over(so_far), F.lit(0))
    rows = rows.withColumns(
        {
            "pages": total((kind == "discover").cast("int")),
            "known": total(F.when(finds, F.col("new")).otherwise(0)),
            "settled": total(F.when(kind == "decide", F.col("n")).otherwise(0)),
            "ended": F.coalesce(F.max((kind == "discover") & ~F.coalesce("has_next", F.lit(False))).over(so_far), F.lit(False)),
            "known_total": F.last(F.when(kind == "discover", F.col("total")), True).over(so_far),
        }
    )
    has_next = F.coalesce("has_next", F.lit(False))
    now = F.col("known") + F.col("new")
    whole = F.coalesce("total", "known_total")
    bad_ids = (F.col("n") == 0) | F.col("repeats") | (F.col("misnamed") > 0)
    fault = (
        F.when(~kind.isin("discover", "amend", "capture", "decide", "reclaim", "redecide"), "unknown_kind")
        .when((kind == "discover") & (F.col("ended") | ~F.col("page").eqNullSafe(F.col("pages") + 1) | bad_ids), "page")
        .when((kind == "discover") & has_next & (F.col("new") == 0), "no_progress")
        .when((kind == "discover") & (F.col("total") < now), "total_too_small")
        .when((kind == "discover") & (F.col("total") != F.col("known_total")), "total_changed")
        .when((kind == "discover") & ~has_next & (whole != now), "ended_before_total")
        .when((kind == "amend") & (F.col("ended") | ~F.col("page").eqNullSafe(F.col("pages")) | ~has_next | bad_ids | (F.col("new") == 0) | ~F.col("total").eqNullSafe(F.col("known_total"))), "amendment")
        .when((kind == "amend") & (F.col("known_total") < now), "total_too_small")
        .when((kind == "capture") & ((F.col("n") == 0) | F.col("repeats") | (F.col("new") > 0) | (F.col("again") > 0)), "capture")
        .when(kind.isin("decide", "reclaim") & (F.col("n") == 0), "no_outcomes")
        .when((kind == "decide") & ((F.col("new") > 0) | (F.col("decided") > 0)), "identity")
        .when((kind == "reclaim") & (F.col("lost") < F.col("n")), "identity")
        .when((kind == "redecide") & (~F.col("ended") | (F.col("settled") < F.col("known")) | (F.col("new") > 0) | (F.col("n") < F.col("known"))), "incomplete")
        .when(kind.isin("decide", "reclaim", "redecide") & (F.col("odd") > 0), "outcome")
        .when((kind == "reclaim") & (F.col("unfit") > 0), "outcome")
        .when(kind.isin("decide", "redecide") & (F.col("bare") > 0), "not_captured")
    )
    return rows.withColumn("fault", fault)


def _valid(rows: DataFrame) -> DataFrame:
    up_to = Window.partitionBy("source").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("__bad", F.max(F.col("fault").isNotNull()).over(up_to)).where(~F.col("__bad")).drop("__bad")


def identities(events: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """(source, id, found_at, captured, outcome): state of every identity after the last valid event; found_at is the seq it was
    found with. rows: from ``judged``."""
    valid = _valid(judged(events) if rows is None else rows)
    named = _named(valid.select(*events.columns))
    return named.groupBy("source", "id").agg(
        F.min(F.when(F.col("kind").isin("discover", "amend"), F.col("seq"))).alias("found_at"),
        F.bool_or(F.col("kind") == "capture").alias("captured"),
        F.max_by("outcome", F.when(F.col("kind").isin("decide", "reclaim", "redecide"), F.col("seq"))).alias("outcome"),
    )


def summary(events: DataFrame, rows: DataFrame | None = None, together: bool = False) -> DataFrame:
    """together: events are partitioned by source, sources are small enough for a task each, and no seq is there twice in one; then
    events are shuffled no more.

    By source: next_page, total, found, captured, decided, failed, pending (not captured and not failed), discovered, complete, and
    the first fault with its seq."""
    rows = (_judged_together(events) if together else judged(events)) if rows is None else rows
    up_to = Window.partitionBy("source").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    valid = ~F.max(F.col("fault").isNotNull()).over(up_to)
    rows = rows.select("source", "seq", "kind", "total", F.coalesce("has_next", F.lit(False)).alias("has_next"), "fault", valid.alias("valid"))
    page = F.col("valid") & (F.col("kind") == "discover") & F.col("source").isNotNull()
    # A row a source: what the judging of events is for. Written, as both the events that count and the result need it.
    sources = swept(rows.groupBy("source").agg(
        (F.count_if(page) + 1).cast("long").alias("next_page"),
        F.max_by("total", F.when(page & F.col("total").isNotNull(), F.col("seq"))).alias("total"),
        F.coalesce(F.bool_or(page & ~F.col("has_next")), F.lit(False)).alias("discovered"),
        F.min(F.when(F.col("fault").isNotNull() & F.col("source").isNotNull(), F.struct("seq", "fault"))).alias("f"),
    ))
    counted = events.select("source", "seq", "kind", "ids", "outcomes").join(sources.select("source", F.col("f.seq").alias("until")).hint("merge"), "source").where("until IS NULL OR seq < until")
    # Fixed-width values alone, so that tasks sum up an identity's events by hash before the shuffle. Outcomes of valid events are not null.
    states = _mentions(counted).groupBy("source", "id").agg(
        F.max((F.col("kind") == "capture").cast("int")).alias("captured"),
        F.max(F.when(F.col("outcome") == "failed", F.col("seq"))).alias("failed_at"),
        F.max(F.when(F.col("outcome") != "failed", F.col("seq"))).alias("other_at"),
    )
    failed = F.col("failed_at").isNotNull() & F.coalesce(F.col("failed_at") > F.col("other_at"), F.lit(True))
    per = states.groupBy("source").agg(
        F.count(F.lit(1)).alias("found"), F.sum("captured").alias("captured"), F.count_if(F.coalesce("failed_at", "other_at").isNotNull()).alias("decided"), F.count_if(failed).alias("failed"), F.count_if((F.col("captured") == 0) & ~failed).alias("pending")
    )
    out = sources.join(per, "source", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    done = F.coalesce(F.col("discovered") & (F.col("decided") == F.col("found")), F.lit(False))
    return out.select("source", "next_page", "total", *[zero(c) for c in ("found", "captured", "decided", "failed", "pending")], "discovered", done.alias("complete"), F.col("f.fault").alias("fault"), F.col("f.seq").alias("fault_at"))


def save(events: DataFrame, root: str) -> int:
    """Publish the state after events as the next version; an error if someone else has published it meanwhile."""
    version = versions.latest(events.sparkSession, root)
    version = 0 if version is None else version + 1
    if not versions.publish(identities(events), root, version):
        raise ValueError(f"version {version} is there already")
    return version


def load(spark: SparkSession, root: str) -> DataFrame | None:
    """The latest state, checked again: identities are there once, captured and decided ones were found, outcomes are known ones."""
    version = versions.latest(spark, root)
    if version is None:
        return None
    state = versions.read(spark, root, version)
    odd = state.where(F.col("found_at").isNull() | ~F.coalesce(F.col("outcome").isin(*OUTCOMES), F.lit(True)) | (~F.col("captured") & F.coalesce(F.col("outcome") != "failed", F.lit(False))))
    if not odd.isEmpty() or not state.groupBy("source", "id").count().where("count > 1").isEmpty():
        raise ValueError("the checkpoint has been changed")
    return state
