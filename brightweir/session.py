"""Session settings and what every job needs from the cluster."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def get_session(app: str = "brightweir", master: str | None = None, partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; on a cluster spark-submit's own settings stay in force."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return (
        builder.config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


#: Environment of Python workers: freed memory goes back to the system, so that idle workers hold little.
WORKER_ENV = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_TRIM_THRESHOLD_": "1000000", "MALLOC_MMAP_THRESHOLD_": "1000000"}


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started from, and bound what a worker holds at once."""
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *parts])
    for k, v in WORKER_ENV.items():
        env.setdefault(k, v)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); a temporary one only where none is set and all runs in one JVM."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        given = "file://" + tempfile.mkdtemp(prefix="brightweir-")
        spark.conf.set("spark.checkpoint.dir", given)
    return given.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a scratch path that nothing reads any more."""
    if not path.startswith(shared_dir(spark) + "/"):
        raise ValueError(f"{path} is not a scratch path")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder and forget the lineage; survives lost executors."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def swept(df: DataFrame) -> DataFrame:
    """``cut``, then Spark deletes the shuffle files of cuts before that nothing can read any more; else they stay until the driver
    happens to collect its garbage."""
    out = cut(df)
    sweep(df.sparkSession)
    return out


def sweep(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files that nothing can read any more."""
    gc.collect()
    spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
