"""Tables that are published a version at a time: written aside, then given their name in one step that fails if it is taken."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _fs(spark, path)
    return fs.exists(at)


def latest(spark: SparkSession, root: str) -> int | None:
    """The highest version under a root; none if there is none."""
    at, fs = _fs(spark, root)
    if not fs.exists(at):
        return None
    found = [int(m[1]) for s in fs.listStatus(at) if (m := re.fullmatch(r"version=(\d+)", s.getPath().getName()))]
    return max(found, default=None)


def publish(df: DataFrame, root: str, version: int) -> bool:
    """Write df as a version; False, and nothing changed, if someone has published it before. A run that dies on the way leaves
    files aside that nothing reads."""
    spark = df.sparkSession
    final, draft = f"{root}/version={version}", f"{root}/_aside-{uuid.uuid4().hex}"
    if exists(spark, final):
        return False
    df.write.parquet(draft)
    a, fs = _fs(spark, draft)
    b, _ = _fs(spark, final)
    # A rename onto a folder that is there would go into it: what it holds then is looked at and taken away again.
    done = fs.rename(a, b)
    inside, _ = _fs(spark, f"{final}/{a.getName()}")
    if fs.exists(inside):
        fs.delete(inside, True)
        return False
    return bool(done)


def read(spark: SparkSession, root: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{root}/version={version}")
