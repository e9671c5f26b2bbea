"""Snapshots in hash buckets with a digest each: an import reads and rewrites the buckets whose content changed, and no others.

A snapshot has a manifest (bucket, digest, rows, held): what a bucket's visible rows sum up to, and the version whose files hold
it. A complete run is compared bucket by bucket first; equal digests are neither read nor written, whatever the snapshot's
size. A run of some rows touches their buckets. Rows that a complete run lacks are kept and marked inactive, and come back
when they are there again. The manifest is published in one step, so a run that dies leaves the snapshot as it was, and the
same version again is not applied twice.

Digests are two sums of 64-bit hashes of the rows' keys and values. Rows without a key are left out; of rows with equal keys
the one with the least values stands.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brightweir.operators import versions

BUCKETS = 64


def bucket_of(key: str, n: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def _digests(rows: DataFrame, key: str, values: list[str]) -> DataFrame:
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), key, *values).cast("decimal(38,0)"))
    return rows.groupBy("bucket").agg(F.concat_ws(":", total(1).cast("string"), total(2).cast("string")).alias("digest"), F.count(F.lit(1)).alias("rows"))


def manifest(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    version = versions.latest(spark, f"{root}/manifests") if version is None else version
    if version is None:
        return spark.createDataFrame([], "bucket int, digest string, rows long, held long")
    return versions.read(spark, f"{root}/manifests", version).select("bucket", "digest", "rows", "held")


def _held(spark: SparkSession, root: str, at: list[tuple[int, int]], schema) -> DataFrame:
    """Rows of buckets from the versions that hold them; the files of others are not listed."""
    if not at:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{root}/data").parquet(*[f"{root}/data/version={v}/bucket={b}" for b, v in at])


def read(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """All rows of the snapshot, inactive ones too; schema: of key and values, as a DDL text."""
    at = [(r["bucket"], r["held"]) for r in manifest(spark, root).collect()]  # a row a bucket
    return _held(spark, root, at, f"{schema}, updated_at timestamp, inactive_at timestamp, version long, bucket int")


def upsert(fresh: DataFrame, root: str, version: int, key: str, values: list[str], now: Column, complete: bool = True, bucket: Column | None = None) -> DataFrame:
    """Bring the snapshot to ``version``: (bucket, outcome, n) of the rows of buckets that were touched, outcome inserted, updated,
    unchanged, reactivated or inactive. Nothing is done, and nothing returned, if that version is there."""
    spark = fresh.sparkSession
    kinds = dict(fresh.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [key, *values])
    none = spark.createDataFrame([], "bucket int, outcome string, n long")
    before = versions.latest(spark, f"{root}/manifests")
    if before is not None and before >= version:
        return none
    own = fresh.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*values)).alias("__v")).select(key, "__v.*").withColumn("bucket", (bucket_of(key) if bucket is None else bucket).cast("int"))
    old = manifest(spark, root, before)
    new = _digests(own, key, values)
    if complete:
        both = old.join(new.withColumnRenamed("digest", "d").withColumnRenamed("rows", "r"), "bucket", "full")
        touched = both.where(~F.col("digest").eqNullSafe(F.col("d"))).select("bucket", "held")
    else:
        touched = new.select("bucket").join(old, "bucket", "left").select("bucket", "held")
    touched = {r["bucket"]: r["held"] for r in touched.collect()}  # a row a bucket
    current = _held(spark, root, [(b, v) for b, v in touched.items() if v is not None], f"{schema}, updated_at timestamp, inactive_at timestamp, version long, bucket int")
    a = current.select(key, *[F.col(v).alias(f"__{v}") for v in values], F.col("updated_at").alias("__at"), F.col("inactive_at").alias("__gone"), F.col("bucket").alias("__bucket"), F.lit(True).alias("__had"))
    b = own.where(F.col("bucket").isin(list(touched))).withColumn("__has", F.lit(True))
    rows = b.join(a, key, "full")
    same = functools.reduce(Column.__and__, [F.col(v).eqNullSafe(F.col(f"__{v}")) for v in values])
    outcome = (
        F.when(F.col("__has").isNull(), F.when(F.lit(complete) & F.col("__gone").isNull(), "inactive").otherwise("kept"))
        .when(F.col("__had").isNull(), "inserted")
        .when(F.col("__gone").isNotNull(), "reactivated")
        .when(same, "unchanged")
        .otherwise("updated")
    )
    rows = rows.withColumn("outcome", outcome)
    moved = F.col("outcome").isin("inserted", "updated", "reactivated", "inactive")
    there = F.col("__has").isNotNull()
    merged = rows.select(
        key,
        *[F.when(there, F.col(v)).otherwise(F.col(f"__{v}")).alias(v) for v in values],
        F.when(moved, F.greatest("__at", now)).otherwise(F.col("__at")).alias("updated_at"),
        F.when(F.col("outcome") == "inactive", now).when(F.col("outcome") == "kept", F.col("__gone")).alias("inactive_at"),
        F.coalesce("bucket", "__bucket").alias("bucket"),
        "outcome",
    )
    staged = f"{root}/staged/version={version}"
    merged.write.mode("overwrite").parquet(staged)
    merged = spark.read.parquet(staged)
    # Files of a version that no manifest names are those of a run that died, and are replaced.
    merged.drop("outcome").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/data/version={version}")
    visible = _digests(merged.where("inactive_at IS NULL"), key, values)
    changed = merged.select("bucket").distinct().join(visible, "bucket", "left").select("bucket", "digest", F.coalesce("rows", F.lit(0)).cast("long").alias("rows"), F.lit(version).cast("long").alias("held"))
    kept = old.where(~F.col("bucket").isin(list(touched)))
    if not versions.publish(kept.unionByName(changed), f"{root}/manifests", version):
        return none
    return merged.where("outcome <> 'kept'").groupBy("bucket", "outcome").agg(F.count(F.lit(1)).alias("n"))
