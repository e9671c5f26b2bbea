"""Checks of reference data, status views and calendar text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightweir.operators.audit import first_of_each
from brightweir.session import cut


def tree_faults(nodes: DataFrame) -> DataFrame:
    """nodes (code, parent): (code, fault) of codes that are there twice, own parents, and parents that aren't there; a
    tree without a root or with several has a row with a null code."""
    codes = nodes.select(F.col("code").alias("parent")).distinct()
    twice = nodes.groupBy("code").count().where("count > 1").select("code", F.lit("duplicate_code").alias("fault"))
    own = nodes.where("code = parent").select("code", F.lit("own_parent").alias("fault"))
    lost = nodes.where("parent IS NOT NULL").join(codes, "parent", "left_anti").select("code", F.lit("unknown_parent").alias("fault"))
    roots = nodes.agg(F.count_if(F.col("parent").isNull()).alias("n")).where("n <> 1").select(F.lit(None).cast("string").alias("code"), F.lit("root_count").alias("fault"))
    return twice.unionByName(own).unionByName(lost).unionByName(roots)


def cycles(edges: DataFrame) -> DataFrame:
    """edges (code, parent): codes that reach themselves. Codes without children or without parents are peeled off until none is left
    to peel. Where every code that stays has one parent, all of them lie on cycles; otherwise some may lie between two, and what
    they reach is found by steps of double length."""
    left = cut(edges.select("code", "parent").where("code IS NOT NULL AND parent IS NOT NULL").distinct())
    n = left.count()
    while n:
        ends = left.select(F.col("code").alias("parent")).distinct()
        starts = left.select(F.col("parent").alias("code")).distinct()
        left = cut(left.join(ends, "parent", "left_semi").join(starts, "code", "left_semi").select("code", "parent"))
        n, before = left.count(), n
        if n == before:
            break
    if left.groupBy("code").count().where("count > 1").isEmpty():
        return left.select("code")
    reach, size = left.select("code", F.col("parent").alias("up")), n
    while True:
        far = reach.select(F.col("code").alias("up"), F.col("up").alias("parent"))
        reach = cut(reach.unionByName(reach.join(far, "up").select("code", F.col("parent").alias("up"))).distinct())
        size, before = reach.count(), size
        if size == before:
            return reach.where("code = up").select("code")


def status_view(catalog: DataFrame, facts: DataFrame, runs: DataFrame, key: str, order: list[Column], is_active: Column) -> DataFrame:
    """catalog with n (facts of the key, 0 for none), and the latest and the latest active run's id; runs has (key, run)."""
    counts = facts.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    latest = first_of_each(runs, [key], order).select(key, F.col("run").alias("latest_run"))
    active = first_of_each(runs.where(is_active), [key], order).select(key, F.col("run").alias("active_run"))
    out = catalog.join(counts, key, "left").join(latest, key, "left").join(active, key, "left")
    return out.withColumn("n", F.coalesce("n", F.lit(0)))


def _escaped(c: Column) -> Column:
    out = F.coalesce(c, F.lit(""))
    for a, b in (("\\", "\\\\"), (";", "\\;"), (",", "\\,"), ("\n", "\\n")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def calendar_event(uid: Column, day: Column, title: Column) -> Column:
    """An all-day event as lines of a calendar file."""
    stamp = lambda c: F.date_format(c, "yyyyMMdd")
    lines = [F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), uid), F.concat(F.lit("DTSTART;VALUE=DATE:"), stamp(day)), F.concat(F.lit("DTEND;VALUE=DATE:"), stamp(F.date_add(day, 1))), F.concat(F.lit("SUMMARY:"), _escaped(title)), F.lit("END:VEVENT")]
    return F.concat_ws("\r\n", *lines)
