"""Published releases: a folder a version, verified before a pointer makes it the active one."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def carried(df: DataFrame, keys: list[str], order: list[str], header: str, out: str) -> DataFrame:
    """df with the last header at or before each row of its group (null before the first)."""
    from pyspark.sql import Window

    so_far = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(header, ignorenulls=True).over(so_far))


#: Rows of a part, about, and how many digits of a part's name a level of the tree takes off.
PART_ROWS, FAN_DIGITS = 4096, 3


def tree(df: DataFrame, keys: list[str], digits: int | None = None) -> DataFrame:
    """(level, part, sha256, rows): hashes of the content, order-free and without a single task. Level 0 is the root.

    Rows are dealt to parts by the first digits of the hash of their keys, so that a row is in the same part of every release; a
    part's hash is over its rows' hashes in order, and a level's over the names and hashes of the parts below. digits: of the
    lowest level; by the number of rows if not given. A row is hashed as JSON with its columns in the order of their names."""
    text = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    rows = df.select(F.sha2(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}), 256).alias("k"), F.sha2(text, 256).alias("h"))
    if digits is None:
        digits, n = 0, df.count()
        while n > PART_ROWS * 16**digits:
            digits += 1
    level = rows.groupBy(F.substring("k", 1, digits).alias("part")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "\n"), 256).alias("sha256"), F.count(F.lit(1)).alias("rows"))
    out = None
    while True:
        out = level.withColumn("level", F.lit(digits)) if out is None else out.unionByName(level.withColumn("level", F.lit(digits)))
        if digits == 0:
            return out.select("level", "part", "sha256", "rows")
        digits = max(0, digits - FAN_DIGITS)
        below = F.transform(F.array_sort(F.collect_list(F.struct("part", "sha256"))), lambda x: F.concat_ws(":", x["part"], x["sha256"]))
        level = level.groupBy(F.substring("part", 1, digits).alias("__p")).agg(F.sha2(F.array_join(below, "\n"), 256).alias("sha256"), F.sum("rows").alias("rows")).withColumnRenamed("__p", "part")


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Parts of the lowest level whose content differs between two trees, or that one of them lacks."""
    low = a.agg(F.max("level")).first()[0]
    x, y = (t.where(F.col("level") == low).select("part", F.col("sha256").alias(n)) for t, n in ((a, "x"), (b, "y")))
    return x.join(y, "part", "full").where("NOT x <=> y").select("part")


def blockers(df: DataFrame, keys: list[str], schema: dict[str, str] | None = None, allowed: dict[str, list] | None = None, unsafe: dict[str, Column] | None = None) -> list[str]:
    """Why a table may not be published: other columns or types than the schema's, null or repeated keys, values outside a
    column's allow-list (null is outside), rows that a safety check finds; with the numbers of rows."""
    kinds = dict(df.dtypes)
    out = [f"schema:{c}" for c in sorted(set(kinds) | set(schema)) if kinds.get(c) != schema.get(c)] if schema is not None else []
    checks = {f"key:{k}": F.col(k).isNull() for k in keys} | {f"not_allowed:{c}": ~F.coalesce(F.col(c).isin(v), F.lit(False)) for c, v in (allowed or {}).items() if c in kinds} | {f"unsafe:{n}": F.coalesce(c, F.lit(False)) for n, c in (unsafe or {}).items()}
    if checks:
        counts = df.agg(*[F.count_if(c).alias(n) for n, c in checks.items()]).first()
        out += [f"{n}={counts[n]}" for n in checks if counts[n]]
    twice = df.groupBy(*keys).count().where("count > 1").count()
    return out + ([f"repeated_keys={twice}"] if twice else [])


def install(df: DataFrame, root: str, version: str, keys: list[str], schema: dict[str, str] | None = None, allowed: dict[str, list] | None = None, unsafe: dict[str, Column] | None = None) -> str:
    """Writes the version under a temporary name, reads it back, and gives it its name and moves the pointer only if nothing in
    what was read back blocks it and its tree of hashes is that of df; what fails is deleted, and its name stays free. A version
    that exists is an error. Earlier versions stay. Returns the root hash."""
    spark, path, staged = df.sparkSession, f"{root}/version={version}", f"{root}/_staged-{version}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs
    final, draft = hadoop.Path(path), hadoop.Path(staged)
    fs = final.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(final):
        raise ValueError(f"{version} already exists")
    try:
        df.write.parquet(staged)
        back = spark.read.parquet(staged)
        if found := blockers(back, keys, schema, allowed, unsafe):
            raise ValueError(f"{version}: {', '.join('keys are not unique' if f.startswith(('repeated_keys', 'key:')) else f for f in found)}")
        made = tree(back, keys)
        made.write.mode("overwrite").parquet(f"{root}/trees/version={version}")
        made = spark.read.parquet(f"{root}/trees/version={version}")
        want = tree(df, keys, made.agg(F.max("level")).first()[0])
        if not (parts := differing(want, made)).isEmpty():
            raise ValueError(f"{version}: what was read back differs in {parts.count()} parts")
        if not fs.rename(draft, final):
            raise ValueError(f"{version} already exists")
    finally:
        fs.delete(draft, True)
    top = made.where("level = 0").first()
    whole = top["sha256"] if top else ""
    spark.createDataFrame([(version, whole)], "version string, root string").withColumn("activated_at", F.current_timestamp()).coalesce(1).write.mode("append").json(f"{root}/pointer")
    return whole


def _pointer(spark: SparkSession, root: str):
    known = spark.read.schema("version string, root string, activated_at timestamp").json(f"{root}/pointer")
    return known.agg(F.max_by(F.struct("version", "root"), F.struct("activated_at", "version")).alias("p")).first()["p"]


def verify(spark: SparkSession, root: str, keys: list[str]) -> list[str]:
    """What is wrong with the active release: its tree isn't the pointer's, or parts of its content aren't the tree's."""
    at = _pointer(spark, root)
    known = spark.read.parquet(f"{root}/trees/version={at['version']}")
    top = known.where("level = 0").first()
    out = [] if (top["sha256"] if top else "") == at["root"] else ["pointer"]
    now = tree(active(spark, root), keys, known.agg(F.max("level")).first()[0])
    return out + sorted(f"part:{r['part']}" for r in differing(known, now).collect())  # a row a part that differs


def active(spark: SparkSession, root: str) -> DataFrame:
    """The version that was activated last; of two at the same instant, the one whose name comes last."""
    return spark.read.parquet(f"{root}/version={_pointer(spark, root)['version']}")
