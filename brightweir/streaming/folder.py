"""A folder of raw documents as a stream that keeps a snapshot up to date.

What has come since the last run is read in batches and ends; each batch is an upsert whose version is the batch's number, so a
batch that is run again, because the run before died after its work or in the middle of it, changes nothing twice. Of the
versions of a document in a batch the one collected last stands; what is older than the snapshot's row is left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightweir.operators import buckets

DOCUMENT = "source_id string, external_id string, title string, body string, collected_at timestamp"
KEY, VALUES = "identity", ["title", "body", "collected_at"]
SNAPSHOT = "identity string, title string, body string, collected_at timestamp"


def newest(documents: DataFrame) -> DataFrame:
    """(identity, title, body, collected_at): the last of each document; documents without an identity are left out."""
    known = documents.where("source_id IS NOT NULL AND external_id IS NOT NULL").withColumn(KEY, F.to_json(F.array("source_id", "external_id")))
    return known.groupBy(KEY).agg(F.max(F.struct("collected_at", "title", "body")).alias("d")).select(KEY, "d.title", "d.body", "d.collected_at")


def apply(batch: DataFrame, number: int, root: str) -> None:
    """One batch; the version after the snapshot's first is number + 1."""
    spark = batch.sparkSession
    fresh = newest(batch)
    have = buckets.read(spark, root, SNAPSHOT).select(KEY, F.col("collected_at").alias("__seen")) if buckets.manifest(spark, root).take(1) else None
    if have is not None:
        fresh = fresh.join(have, KEY, "left").where("__seen IS NULL OR collected_at >= __seen").drop("__seen")
    buckets.upsert(fresh, root, number + 1, KEY, VALUES, F.current_timestamp(), complete=False)


def follow(spark: SparkSession, raw: str, root: str, state: str, files_a_batch: int = 100, each: Callable[[DataFrame, int, str], None] = apply) -> None:
    """Read what is new under ``raw`` (JSON documents, a line each) into the snapshot under ``root``, then end; ``state`` holds
    how far the stream has come."""
    stream = spark.readStream.schema(DOCUMENT).option("maxFilesPerTrigger", files_a_batch).json(raw)
    run = stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(lambda df, n: each(df, n, root)).start()
    run.awaitTermination()
