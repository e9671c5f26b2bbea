"""Registered queries over payloads as sources send them, and over texts put together from columns, with their rules as SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from brightweir.catalog_queries import _query
from brightweir.functions import wording
from brightweir.operators import normalize
from brightweir.session import scratch, table
from brightweir.sources import raw


@_query("""WITH s AS (SELECT s_suppkey AS k, s_name AS n, s_nationkey AS g, s_acctbal AS bal FROM supplier)
SELECT k, CASE WHEN k % 5 = 4 OR k % 7 = 0 THEN n WHEN k % 3 = 0 AND k % 4 <> 0 THEN 'D ' || n || ' v2' ELSE 'D ' || n END AS name, bal > 0 AS positive, CASE WHEN k % 5 <> 4 AND k % 2 = 0 THEN CAST(k % 40 AS INT) END AS age, 'grade ' || (k % 6) AS grade, k % 5 <> 4 AND k % 11 = 0 AS orphan FROM s""")
def stored_items(spark, d):
    """Suppliers from a raw store: JSON lists of a nation, XML details in two versions, some with a hash that doesn't fit, and a
    CSV beside them; details are preferred where they say something."""
    at = scratch(spark, "raw")
    k, name = F.col("s_suppkey"), F.col("s_name")
    s = table(spark, d, "supplier").withColumn("source_id", F.concat(F.lit("n"), "s_nationkey"))
    lists = s.groupBy("source_id").agg(F.to_json(F.struct(F.struct(F.array_sort(F.collect_list(F.struct(k.cast("string").alias("id"), name.alias("name"), F.col("s_acctbal").alias("bal")))).alias("policies")).alias("result"))).alias("body"))
    none = F.lit(None).cast("string")
    head = lists.select("source_id", F.concat(F.lit("l-"), "source_id").alias("document_id"), F.lit("list_response").alias("document_role"), none.alias("external_id"), none.alias("parent_document_id"), F.lit("1996-01-01").cast("timestamp").alias("collected_at"), F.lit("json").alias("raw_format"), "body")
    versions = s.where(k % 5 != 4).withColumn("v", F.explode(F.when(k % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    said = F.when(k % 7 == 0, " ").otherwise(F.concat(F.lit("D "), name, F.when(F.col("v") == 2, " v2").otherwise("")))
    xml = F.concat(F.lit("<?xml version='1.0'?><detail><id>"), k, F.lit("</id><name>"), said, F.lit("</name>"), F.when(k % 2 == 0, F.concat(F.lit("<age>"), k % 40, F.lit("</age>"))).otherwise("<age/>"), F.lit("</detail>"))
    parent = F.when(k % 11 == 0, "lost").otherwise(F.concat(F.lit("l-"), "source_id"))
    details = versions.select("source_id", F.concat_ws("-", F.lit("d"), k, "v").alias("document_id"), F.lit("detail_response").alias("document_role"), k.cast("string").alias("external_id"), parent.alias("parent_document_id"), F.date_add(F.lit("1996-01-01"), F.col("v")).cast("timestamp").alias("collected_at"), F.lit("xml").alias("raw_format"), xml.alias("body"))
    docs = raw.sealed(head.unionByName(details).withColumns({"body": F.col("body").cast("binary"), "source_url": F.lit("https://x")}), "body")
    torn = (F.col("raw_format") == "xml") & F.col("document_id").endswith("-2") & (F.col("external_id").cast("long") % 4 == 0)
    raw.save(docs.withColumn("content_hash", F.when(torn, "sha256:0").otherwise(F.col("content_hash"))), at)
    good = raw.load(spark, at).where(F.size(raw.faults()) == 0)
    listed = raw.json_items(good.where("document_role = 'list_response'"), "result struct<policies: array<struct<id: string, name: string, bal: double>>>").select(F.explode("item.result.policies").alias("p")).select("p.*")
    found = raw.xml_items(raw.newest(good.where("document_role = 'detail_response'")), "id string, name string, age int", "detail").select(F.col("external_id").alias("id"), F.col("item.name").alias("detail_name"), "item.age")
    lone = raw.orphans(good).select(F.col("external_id").alias("id")).distinct().withColumn("orphan", F.lit(True))
    csv = scratch(spark, "grades")
    s.select(k.alias("id"), F.concat(F.lit("grade "), k % 6).alias("grade")).write.option("header", True).csv(csv)
    rows = listed.join(found, "id", "left").join(lone, "id", "left").join(raw.csv_items(spark, csv, ["id", "grade"]), "id", "left")
    return rows.select(F.col("id").cast("long").alias("k"), normalize.preferred(F.col("detail_name"), F.col("name")).alias("name"), (F.col("bal") > 0).alias("positive"), "age", "grade", F.coalesce("orphan", F.lit(False)).alias("orphan"))


_DATES = {0: ("from 2026.1.5 on", True), 1: ("in 2024.5", False), 2: ("''24년 5월 3일", True), 3: ("call 02-2026-11", False), 4: ("2026 - 3 - 17까지", True), 5: ("1899.1.1 or 2101-1-1", False), 6: ("2026년 상반기 중 3.2", True)}


@_query(f"""WITH p AS (SELECT p_partkey AS k, p_name AS t, p_brand AS b, p_type AS y, p_size AS s, p_partkey % 4 AS a, p_size % 4 AS c, p_partkey % 3 AS e, p_size % 2 AS f FROM part)
SELECT k AS id, CASE WHEN a < 3 THEN t ELSE t || ' new plan' END AS title, CASE WHEN e = 2 THEN 'First ' || y || ' rent for ' ELSE 'rent for ' END || b || CASE WHEN f = 0 THEN '!' ELSE ' last.' END AS sentence,
  CASE WHEN c >= 2 THEN array_to_string([t || ' ' || i FOR i IN range(1, c + 1)], '|') WHEN c = 1 THEN '1. ' || t || ' 1|tail ' || b ELSE 'tail ' || b END AS numbered,
  CASE WHEN s % 3 = 0 THEN t || '|' || b WHEN s % 3 = 1 THEN t || '|' || b || '|' || y ELSE t || ' - ' || b END AS marked, CASE k % 7 {" ".join(f"WHEN {i} THEN {str(v).lower()}" for i, (_, v) in _DATES.items())} END AS dated,
  CASE WHEN a = 0 THEN 'who' WHEN a = 1 AND f = 0 THEN 'how' END AS section, replace(replace(y, 'ECONOMY', 'LOW'), 'LOWEST', 'low') || ' city' AS expanded FROM p""")
def worded_columns(spark, d):
    """Titles, sentences, items, dates and headers put together from names, types, sizes and keys, and taken apart again."""
    k, s = F.col("p_partkey"), F.col("p_size").cast("int")
    t, b, y = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    pick = lambda key, *vs: F.element_at(F.array(*[F.lit(v) if isinstance(v, str) else v for v in vs]), (key + 1).cast("int"))
    lines = F.when(s % 4 > 0, F.transform(F.sequence(F.lit(1), s % 4), lambda i: F.concat(i, F.lit(". "), t, F.lit(" "), i))).otherwise(F.array().cast("array<string>"))
    marked = pick(s % 3, F.concat(F.lit("<p>※ "), t, F.lit("</p> ※ "), b), F.concat(F.lit("• "), t, F.lit("\n\n- "), b, F.lit("\r\n* "), y), F.concat(t, F.lit(" - "), b))
    joined = lambda c: F.array_join(c, "|")
    header = F.when(k % 4 == 0, F.concat(F.lit("○ Target ("), b, F.lit(")"))).when(k % 4 == 1, pick(s % 2, "-  Method", F.concat(F.lit("Method "), b))).otherwise(t)
    return table(spark, d, "part").select(
        k.alias("id"),
        wording.list_title(F.concat(F.lit(" "), F.replace(t, F.lit(" "), F.lit("  ")), pick(k % 4, "", " NEW", " 12일전 ", " new plan"))).alias("title"),
        wording.sentence_with(F.concat(F.lit("First "), y, pick(k % 3, ". ", "다 ", " "), F.lit("rent  for "), b, pick(s % 2, "! ", " "), F.lit("last.")), "rent").alias("sentence"),
        joined(wording.items(F.concat_ws("\n", lines, F.concat(F.lit("tail "), b)))).alias("numbered"),
        joined(wording.items(marked)).alias("marked"),
        wording.names_a_date(pick(k % 7, *[v.replace("''", "'") for v, _ in _DATES.values()])).alias("dated"),
        wording.section_key(header, {"Target": "who", "Method": "how"}).alias("section"),
        wording.expanded(F.concat(y, F.lit(" t.")), {"ECONOMY": "LOW", "LOWEST": "low", "t.": "city"}).alias("expanded"),
    )
