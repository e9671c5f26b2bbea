"""Sources and the raw store: documents as they came, with their hash and length, and readers that check what they read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RAW = "document_id string, document_role string, external_id string, parent_document_id string, source_url string, collected_at timestamp, raw_format string, raw_payload_base64 string, content_hash string, byte_length bigint"


def sealed(df: DataFrame, payload: str) -> DataFrame:
    """df with a binary column replaced by its base64 text, hash and length."""
    return df.withColumns({"raw_payload_base64": F.base64(payload), "content_hash": F.concat(F.lit("sha256:"), F.sha2(payload, 256)), "byte_length": F.octet_length(payload).cast("long")}).drop(payload)


def faults() -> Column:
    """What is wrong with a raw document: an array of codes, empty if nothing is."""
    body = F.unbase64("raw_payload_base64")
    return F.array_compact(
        F.array(
            F.when(F.col("document_id").isNull(), "missing_id"),
            F.when(~F.col("content_hash").eqNullSafe(F.concat(F.lit("sha256:"), F.sha2(body, 256))), "hash"),
            F.when(~F.col("byte_length").eqNullSafe(F.octet_length(body).cast("long")), "length"),
            F.when(~F.coalesce(F.col("document_role").isin("list_response", "list_item", "detail_response"), F.lit(False)), "role"),
            F.when((F.col("document_role") != "list_response") & F.col("parent_document_id").isNull(), "no_parent"),
        )
    )


def save(df: DataFrame, root: str) -> None:
    """Write once, a folder a source; what exists is never overwritten."""
    df.write.mode("errorifexists").partitionBy("source_id").json(root)


def load(spark: SparkSession, root: str, source_id: str | None = None) -> DataFrame:
    """Documents of the store; the folder says whose they are, and a filter on source_id reads only its folder."""
    df = spark.read.schema(f"{RAW}, source_id string").json(root)
    return df.where(F.col("source_id") == source_id) if source_id is not None else df


def misplaced(spark: SparkSession, root: str) -> DataFrame:
    """(document_id, says, source_id): documents that say that they are of another source than the folder that they are in."""
    lines = spark.read.text(root).select(F.get_json_object("value", "$.document_id").alias("document_id"), F.get_json_object("value", "$.source_id").alias("says"), F.col("source_id").cast("string").alias("source_id"))
    return lines.where("says <> source_id")


def orphans(df: DataFrame) -> DataFrame:
    """Documents whose parent isn't there."""
    parents = df.select(F.col("document_id").alias("parent_document_id")).distinct()
    return df.where("parent_document_id IS NOT NULL").join(parents, "parent_document_id", "left_anti").select(*df.columns)


def newest(df: DataFrame) -> DataFrame:
    """The latest document of each role and external id (by time, then id)."""
    row = F.struct(*df.columns)
    last = df.groupBy("document_role", "external_id").agg(F.max_by(row, F.struct("collected_at", "document_id")).alias("r"))
    return last.select("r.*")


def csv_items(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of CSV files as text; headers other than these, in this order, are an error."""
    df = spark.read.option("header", True).csv(path)
    if df.columns != columns:
        raise ValueError(f"expected columns {columns}, found {df.columns}")
    return df


def json_items(df: DataFrame, schema: str) -> DataFrame:
    """Raw JSON documents with their payload parsed as column item; malformed ones have a null item."""
    return df.withColumn("item", F.from_json(F.decode(F.unbase64("raw_payload_base64"), "UTF-8"), schema, {"mode": "PERMISSIVE"}))


def json_array(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Seed files, each an array of objects: (rows with file, index from 0 and item; faults: file, fault where the root is no
    array or the file no JSON). A file is a row until it is exploded."""
    files = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("root"))
    fault = F.when(F.col("root").isNull(), "seed_not_json").when(~F.schema_of_variant("root").startswith("ARRAY"), "seed_root_not_array")
    judged = files.withColumn("fault", fault)
    rows = judged.where("fault IS NULL").select("file", F.posexplode(F.variant_get("root", "$", "array<variant>")).alias("index", "v"))
    return rows.select("file", "index", F.try_variant_get("v", "$", schema).alias("item")), judged.where("fault IS NOT NULL").select("file", "fault")


def xml_items(df: DataFrame, schema: str, row_tag: str) -> DataFrame:
    """Raw XML documents with their payload parsed as column item."""
    return df.withColumn("item", F.from_xml(F.decode(F.unbase64("raw_payload_base64"), "UTF-8"), schema, {"rowTag": row_tag, "ignoreNamespace": "true"}))


def log_events(spark: SparkSession, path: str, level: str | None = None, text: str | None = None) -> DataFrame:
    """JSON lines with defaults; malformed lines are skipped; level without regard to case, text anywhere in the event."""
    lines = spark.read.text(path).select(F.from_json("value", "timestamp string, level string, component string, event string").alias("e")).select("e.*")
    lines = lines.where("timestamp IS NOT NULL OR event IS NOT NULL").select("timestamp", F.coalesce("level", F.lit("INFO")).alias("level"), F.coalesce("component", F.lit("app")).alias("component"), F.coalesce("event", F.lit("")).alias("event"))
    if level:
        lines = lines.where(F.lower("level") == level.lower())
    return lines.where(F.contains("event", F.lit(text))) if text else lines
