"""Reports: counts, profiles, samples, transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_null_bucket(df: DataFrame, col: str) -> DataFrame:
    """(value, n): rows of each value, nulls under 'null'."""
    return df.groupBy(F.coalesce(F.col(col).cast("string"), F.lit("null")).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def repeated_groups(df: DataFrame, key: Column) -> DataFrame:
    """One row: how many keys occur more than once, their rows, the largest group, and how many keys there are."""
    per = df.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    more = F.col("n") > 1
    return per.agg(F.count_if(more).alias("groups"), F.coalesce(F.sum(F.when(more, F.col("n"))), F.lit(0)).alias("rows_in_groups"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"), F.count(F.lit(1)).alias("keys"))


def field_profile(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, present, missing, empty, presence_rate): one pass over df, then a row a field."""
    aggs = [F.count(F.lit(1)).alias("all")]
    for f in fields:
        aggs += [F.count(f).alias(f"p_{f}"), F.count_if(F.col(f).cast("string") == "").alias(f"e_{f}")]
    one = df.agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"p_{f}").alias("present"), (F.col("all") - F.col(f"p_{f}")).alias("missing"), F.col(f"e_{f}").alias("empty")) for f in fields]))
    return one.select("all", rows.alias("r")).select("r.*", (F.col("r.present") / F.col("all")).alias("presence_rate"))


def first_of_each(df: DataFrame, keys: list[str], order: list[Column], n: int | None = 1) -> DataFrame:
    """The first n rows of each group (None: all of them) with their place from 1; Spark prunes groups before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    if n is None:
        return df.withColumn("place", place.cast("long"))
    return df.withColumn("place", place).where(F.col("place") <= n).withColumn("place", F.col("place").cast("long"))


def met(left: DataFrame, right: DataFrame, key: str, salts: int = 16) -> DataFrame:
    """Left join of many rows with a row a key, where a key may hold much of the left side: its rows are dealt to several parts, and
    the right side, which should have repeated keys alone, goes to all of them. Spark sizes that side as if it were there once, so
    whether to broadcast it is not left to Spark."""
    a = left.withColumn("__salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
    b = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a.join(b.hint("merge"), [key, "__salt"], "left").drop("__salt")


def transitions(old: DataFrame, new: DataFrame, key: str, state: str, allowed: set[tuple[str, str]]) -> DataFrame:
    """(change, n, allowed): how many keys went from which state to which; absent on a side is 'none'."""
    a, b = old.select(key, F.col(state).alias("a")), new.select(key, F.col(state).alias("b"))
    both = a.join(b, key, "full").select(F.coalesce("a", F.lit("none")).alias("a"), F.coalesce("b", F.lit("none")).alias("b"))
    change = F.concat_ws("->", "a", "b")
    return both.groupBy(change.alias("change")).agg(F.count(F.lit(1)).alias("n")).withColumn("allowed", F.col("change").isin([f"{x}->{y}" for x, y in sorted(allowed)]))


def totals(df: DataFrame, key: str, aggs: dict[str, Column]) -> DataFrame:
    """A row for each key and one for all of them, under 'total'."""
    out = df.rollup(key).agg(F.grouping(key).alias("g"), *[c.alias(n) for n, c in aggs.items()])
    return out.select(F.when(F.col("g") == 1, "total").otherwise(F.col(key)).alias("key"), *aggs)


def bounds_histogram(df: DataFrame, low: str, high: str) -> DataFrame:
    """One row: how many rows have both bounds, one, or none."""
    a, b = F.col(low).isNotNull(), F.col(high).isNotNull()
    return df.agg(F.count_if(a & b).alias("both_bounds"), F.count_if(a != b).alias("one_bound"), F.count_if(~a & ~b).alias("no_bounds"))


def term_counts(df: DataFrame, col: str, terms: list[str], visible: Column) -> DataFrame:
    """(term, hits, visible): rows that contain each term, in all and of the visible ones; one pass."""
    low = F.lower(F.coalesce(F.col(col), F.lit("")))
    one = df.agg(*[F.count_if(low.contains(t.lower())).alias(f"a{i}") for i, t in enumerate(terms)], *[F.count_if(low.contains(t.lower()) & visible).alias(f"b{i}") for i, t in enumerate(terms)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"a{i}").alias("hits"), F.col(f"b{i}").alias("visible")) for i, t in enumerate(terms)])).alias("r")).select("r.*")


def combinations(df: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """(combination, n): rows by the sorted names of the reasons that hold, joined by a plus."""
    held = F.array_compact(F.array(*[F.when(reasons[n], n) for n in sorted(reasons)]))
    return df.groupBy(F.array_join(held, "+").alias("combination")).agg(F.count(F.lit(1)).alias("n"))


def pivoted(df: DataFrame, key: str, value: str, kinds: tuple[str, ...]) -> DataFrame:
    """A row a key with the count of each kind, and of all rows."""
    return df.groupBy(key).agg(*[F.count_if(F.col(value) == k).alias(k) for k in kinds], F.count(F.lit(1)).alias("total"))


def split_by_reason(df: DataFrame, reasons: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that are kept, rows that are dropped with the first reason that holds, in the order given)."""
    first = F.coalesce(*[F.when(c, n) for n, c in reasons.items()])
    rows = df.withColumn("reason", first)
    return rows.where("reason IS NULL").drop("reason"), rows.where("reason IS NOT NULL")
