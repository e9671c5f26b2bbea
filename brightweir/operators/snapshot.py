"""Snapshots: classified upsert, soft delete, first occurrence; each gives the next snapshot, none changes a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Full outer join on the keys: the next row and its outcome (inserted, updated, unchanged, absent).

    A null in a key matches nothing, as in SQL. Columns: keys, values, outcome."""
    a, b = current.select(*keys, *values, F.lit(True).alias("__has")).alias("a"), incoming.select(*keys, *values, F.lit(True).alias("__has")).alias("b")
    both = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys], "full")
    same = F.lit(True)
    for v in values:
        same = same & F.col(f"a.{v}").eqNullSafe(F.col(f"b.{v}"))
    outcome = F.when(F.col("a.__has").isNull(), "inserted").when(F.col("b.__has").isNull(), "absent").when(same, "unchanged").otherwise("updated")
    new = F.col("b.__has").isNotNull()
    return both.select(*[F.coalesce(f"b.{k}", f"a.{k}").alias(k) for k in keys], *[F.when(new, F.col(f"b.{v}")).otherwise(F.col(f"a.{v}")).alias(v) for v in values], outcome.alias("outcome"))


def soft_delete(current: DataFrame, seen: DataFrame, protected: DataFrame, key: str, when: Column) -> DataFrame:
    """current with inactive_at set where the key was neither seen nor is protected; a null key counts as not seen."""
    keep = seen.select(key).unionByName(protected.select(key)).where(F.col(key).isNotNull()).distinct().withColumn("__keep", F.lit(True))
    return current.join(keep, key, "left").withColumn("inactive_at", F.when(F.col("__keep").isNull(), when)).drop("__keep")


def merged(rows: DataFrame, key: str, order: list[str], values: list[str], availability: str | None = None, groups: str | None = None) -> DataFrame:
    """One row a key from several pages: of each value the first that isn't blank; availability is open if any page says so,
    else the first that isn't unknown; groups (an array column) one after another, each value once."""
    at = F.struct(*order)
    said = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    aggs = [F.min(F.when(said(v).isNotNull(), F.struct(at.alias("at"), said(v).alias("v"))))["v"].alias(v) for v in values]
    if availability:
        known = F.when(F.coalesce(F.col(availability) != "unknown", F.lit(False)), F.struct(at.alias("at"), F.col(availability).alias("v")))
        aggs.append(F.when(F.bool_or(F.col(availability) == "open"), "open").otherwise(F.coalesce(F.min(known)["v"], F.lit("unknown"))).alias(availability))
    if groups:
        every = F.array_sort(F.collect_list(F.struct(at.alias("at"), F.coalesce(F.col(groups), F.array().cast("array<string>")).alias("v"))))
        aggs.append(F.array_distinct(F.flatten(F.transform(every, lambda x: x["v"]))).alias(groups))
    return rows.groupBy(key).agg(*aggs)


def keep_latest(rows: DataFrame, key: str, order: list[Column], state: str, active: str, ended: str) -> DataFrame:
    """rows with all but the first active row of each key set to ``ended``."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(key, F.col(state) == active).orderBy(*order))
    return rows.withColumn("__place", place).withColumn(state, F.when((F.col(state) == active) & (F.col("__place") > 1), ended).otherwise(F.col(state))).drop("__place")


def reactivated(inactive_before: Column, seen: Column, changed: Column) -> Column:
    """Outcome of a row of an import: reactivation counts as an update."""
    return F.when(~seen, "absent").when(inactive_before | changed, "updated").otherwise("unchanged")
