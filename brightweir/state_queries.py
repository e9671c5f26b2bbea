"""Registered queries of snapshots, checkpoints, verified scans, releases and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brightweir.catalog_queries import _query
from brightweir.functions import schema
from brightweir.operators import buckets, checkpoints, release
from brightweir.session import cut, scratch, sweep, table
from brightweir.sources import verified
from brightweir.streaming import folder

#: Lines of all customers of a task, about, and of one customer whose events may stay together in a task.
LINES = TOGETHER = 500_000


@_query("""WITH o AS (SELECT o_orderkey AS k, o_orderkey % 64 AS b, o_custkey AS c, o_orderstatus AS s FROM orders),
n AS (SELECT *, b = 7 AND k % 3 = 0 AS changed, b = 9 AND k % 5 = 0 AS gone, b = 11 AND k % 7 = 0 AS late FROM o),
t AS (SELECT b, bool_or(changed OR gone OR late) AS touched FROM n GROUP BY b)
SELECT k, CASE WHEN changed THEN c + 1 ELSE c END AS c, s, n.b AS bucket, CAST(touched AS BIGINT) AS held, CAST(CASE WHEN changed OR gone OR late THEN 2 ELSE 1 END AS INT) AS updated_day, gone AS inactive FROM n JOIN t ON t.b = n.b""")
def bucketed_upsert(spark, d):
    """A snapshot of orders and a second complete run, of which three of 64 buckets differ: only their files are new."""
    root = scratch(spark, "snapshot")
    k = F.col("k")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_orderstatus").alias("s"))
    day = lambda n: F.lit(f"1996-01-0{n}").cast("timestamp")
    by = F.pmod(k, F.lit(64))
    late = (k % 64 == 11) & (k % 7 == 0)
    buckets.upsert(rows.where(~late), root, 0, "k", ["c", "s"], day(1), bucket=by)
    later = rows.where(~((k % 64 == 9) & (k % 5 == 0))).withColumn("c", F.when((k % 64 == 7) & (k % 3 == 0), F.col("c") + 1).otherwise(F.col("c")))
    buckets.upsert(later, root, 1, "k", ["c", "s"], day(2), bucket=by)
    out = buckets.read(spark, root, "k bigint, c bigint, s string")
    return out.select("k", "c", "s", F.col("bucket").cast("long").alias("bucket"), F.col("version").alias("held"), F.dayofmonth("updated_at").alias("updated_day"), F.col("inactive_at").isNotNull().alias("inactive"))


@_query("""WITH e AS (SELECT 'u' || user_id AS source, event_id % 50 AS id, event_type, CAST(ts AS TIMESTAMP) AS ts, event_id FROM events WHERE event_id % 17 <> 0)
SELECT '["' || source || '","' || id || '"]' AS identity, event_type AS title, CAST(event_id AS VARCHAR) AS body FROM e QUALIFY row_number() OVER (PARTITION BY source, id ORDER BY ts DESC, event_type DESC, CAST(event_id AS VARCHAR) DESC) = 1""")
def followed_folder(spark, d):
    """Events as raw documents in a folder that is followed in three batches, the second of which is run twice."""
    raw, root, state = scratch(spark, "raw"), scratch(spark, "snapshot"), scratch(spark, "state")
    e = F.col("event_id")
    known = F.when(e % 17 != 0, (e % 50).cast("string"))
    docs = table(spark, d, "events").select(F.concat(F.lit("u"), "user_id").alias("source_id"), known.alias("external_id"), F.col("event_type").alias("title"), e.cast("string").alias("body"), F.col("ts").cast("timestamp").alias("collected_at"))
    docs.repartition(3, "body").write.json(raw)

    def twice(batch, number, at):
        folder.apply(batch, number, at)
        if number == 1:
            folder.apply(batch, number, at)

    folder.follow(spark, raw, root, state, files_a_batch=1, each=twice)
    return buckets.read(spark, root, folder.SNAPSHOT).select("identity", "title", "body")


@_query("""WITH l AS (SELECT DISTINCT o_custkey AS c, o_orderkey AS o, l_partkey AS p FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
pages AS (SELECT c, o, row_number() OVER (PARTITION BY c ORDER BY o) AS page, o = max(o) OVER (PARTITION BY c) AS final FROM (SELECT DISTINCT c, o FROM l)),
new AS (SELECT c, p, min(o) AS o FROM l GROUP BY c, p), ids AS (SELECT new.*, page * 10 AS spot FROM new JOIN pages ON pages.c = new.c AND pages.o = new.o),
f AS (SELECT pages.c, min(CASE WHEN pages.o % 29 = 0 OR (NOT final AND n IS NULL) THEN page * 10 WHEN pages.o % 31 = 0 AND bare THEN page * 10 + 2 END) AS bad,
  min_by(CASE WHEN pages.o % 29 = 0 THEN 'page' WHEN NOT final AND n IS NULL THEN 'no_progress' ELSE 'not_captured' END, page) FILTER (WHERE pages.o % 29 = 0 OR (NOT final AND n IS NULL) OR (pages.o % 31 = 0 AND bare)) AS fault
  FROM pages LEFT JOIN (SELECT c, o, count(*) AS n, bool_or(p % 5 = 0) AS bare FROM new GROUP BY c, o) k ON k.c = pages.c AND k.o = pages.o GROUP BY pages.c),
s AS (SELECT ids.c, spot, p % 5 <> 0 AND spot + 1 < coalesce(bad, 1e9) AS captured, CASE WHEN spot + 2 >= coalesce(bad, 1e9) THEN NULL WHEN p % 5 = 0 OR (p % 3 = 2 AND NOT (p % 2 = 0 AND spot + 3 < coalesce(bad, 1e9))) THEN 'failed' WHEN p % 3 = 2 THEN 'review' WHEN p % 3 = 1 THEN 'closed' ELSE 'accepted' END AS outcome
  FROM ids JOIN f ON f.c = ids.c WHERE spot < coalesce(bad, 1e9)),
n AS (SELECT c, count(*) AS found, count(*) FILTER (WHERE captured) AS captured, count(outcome) AS decided, count(*) FILTER (WHERE outcome = 'failed') AS failed, count(*) FILTER (WHERE NOT captured AND coalesce(outcome <> 'failed', true)) AS pending FROM s GROUP BY c),
g AS (SELECT pages.c, count(*) FILTER (WHERE page * 10 < coalesce(bad, 1e9)) + 1 AS next_page, coalesce(bool_or(final AND page * 10 < coalesce(bad, 1e9)), false) AS discovered FROM pages JOIN f ON f.c = pages.c GROUP BY pages.c)
SELECT 'c' || g.c AS source, next_page, coalesce(found, 0) AS found, coalesce(captured, 0) AS captured, coalesce(decided, 0) AS decided, coalesce(failed, 0) AS failed, coalesce(pending, 0) AS pending, discovered, coalesce(discovered AND decided = found, false) AS complete, fault, CAST(bad AS BIGINT) AS fault_at
FROM g JOIN f ON f.c = g.c LEFT JOIN n ON n.c = g.c""")
def checkpoint_fold(spark, d):
    """Each customer's orders as events of a source: pages, captures, decisions, reclaims, and some that are refused."""
    # Lines meet their order once and customers' orders meet once; of an order's parts, those that are new to its customer follow from there.
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("o")).hint("merge")
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p"))
    by_source = Window.partitionBy("c").orderBy("o")
    own = orders.join(lines, "o").groupBy("c", "o").agg(F.collect_set("p").alias("ps")).repartition("c")
    own = own.withColumns({"page": F.row_number().over(by_source), "has_next": F.lead("o").over(by_source).isNotNull()})
    each = own.select("c", "o", "page", "has_next", F.explode_outer("ps").alias("p"))
    is_new = F.row_number().over(Window.partitionBy("c", "p").orderBy("o")) == 1
    rows = each.withColumn("is_new", is_new).groupBy("c", "o", "page", "has_next").agg(F.collect_list("p").alias("ids"), F.collect_list(F.when(F.col("is_new"), F.col("p"))).alias("new"))
    path = scratch(spark, "orders")
    rows.write.parquet(path)
    sweep(spark)
    rows = spark.read.parquet(path)
    n, most = rows.groupBy("c").agg(F.sum(F.size("ids")).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    rows = rows.withColumn("source", F.concat(F.lit("c"), "c"))
    # A customer's events make some 400 bytes a line in their task, which Spark does not see in the rows that it deals.
    rows = rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // LINES), "source")
    text = lambda xs: F.transform(xs, lambda p: p.cast("string"))
    told = lambda p, bare: F.when(p % 5 == 0, F.when(bare, "accepted").otherwise("failed")).when(p % 3 == 2, "failed").when(p % 3 == 1, "closed").otherwise("accepted")
    caught = F.filter("new", lambda p: p % 5 != 0)
    back = F.filter("new", lambda p: (p % 5 != 0) & (p % 3 == 2) & (p % 2 == 0))
    each = lambda xs, f: F.map_from_arrays(text(xs), F.transform(xs, f))
    kinds = {
        "discover": (F.lit(True), 0, text(F.col("ids")), None),
        "capture": (F.size(caught) > 0, 1, text(caught), None),
        "decide": (F.size("new") > 0, 2, None, each(F.col("new"), lambda p: told(p, F.col("o") % 31 == 0))),
        "reclaim": (F.size(back) > 0, 3, None, each(back, lambda p: F.lit("review"))),
    }
    one = lambda kind, there, step, ids, outcomes: F.when(
        there,
        F.struct(
            (F.col("page") * 10 + step).cast("long").alias("seq"), F.lit(kind).alias("kind"), F.when(F.lit(step) == 0, F.col("page") + (F.col("o") % 29 == 0).cast("int")).cast("int").alias("page"),
            (F.lit(None).cast("array<string>") if ids is None else ids).alias("ids"), F.lit(None).cast("long").alias("total"), F.when(F.lit(step) == 0, F.col("has_next")).alias("has_next"), (F.lit(None).cast("map<string,string>") if outcomes is None else outcomes).alias("outcomes"),
        ),
    )
    each_row = F.explode(F.array_compact(F.array(*[one(kind, *rest) for kind, rest in kinds.items()])))
    events = rows.select("source", each_row.alias("e")).select("source", "e.*")
    together = most <= TOGETHER
    return checkpoints.summary(events if together else cut(events), together=together).drop("total")


@_query("""WITH f AS (SELECT n_nationkey AS k, 'part-' || n_nationkey AS path, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2)
SELECT path, fault, CASE WHEN fault IS NULL THEN n END AS rows FROM (SELECT path, n, unnest(CASE WHEN n = 0 THEN CASE WHEN k % 6 = 5 THEN [] ELSE ['missing'] END WHEN k % 6 = 1 THEN ['hash_differs'] WHEN k % 6 = 2 THEN ['count_differs'] WHEN k % 6 = 3 THEN ['size_differs'] WHEN k % 6 = 5 THEN ['not_in_manifest'] ELSE [NULL] END) AS fault FROM f)""")
def verified_scan(spark, d):
    """Customers as packed files, one a nation, read against a manifest that is wrong about some of them."""
    at = scratch(spark, "reference")
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    c.withColumn("n", F.col("c_nationkey")).repartition("n").write.partitionBy("n").option("header", "true").option("compression", "gzip").csv(at)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv*").load(at).select("path")
    k = F.regexp_extract("path", r"n=(\d+)/", 1).cast("long")
    named = files.select(k.alias("k"), verified.name(F.col("path"), at).alias("path"))
    true = named.join(verified.digests(spark, at), "path").join(c.groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n")), "k")
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"))
    told = nations.join(true, "k", "left").where("k % 6 <> 5").select(
        F.coalesce("path", F.concat(F.lit("part-"), "k")).alias("path"), F.when(F.col("k") % 6 == 1, F.reverse("sha256")).otherwise(F.col("sha256")).alias("sha256"), F.when(F.col("k") % 6 == 3, F.col("bytes") + 1).otherwise(F.col("bytes")).alias("bytes"), F.when(F.col("k") % 6 == 2, F.col("n") - 1).otherwise(F.col("n")).alias("rows"), F.lit("s1").alias("scheme")
    )
    told = cut(told)
    rows, faults = verified.scanned(spark, at, told, "c_custkey long, c_name string, c_nationkey long", "c_custkey")
    number = named.select("path", F.concat(F.lit("part-"), "k").alias("name"))
    wrong = faults.join(number, "path", "left").select(F.coalesce("name", "path").alias("path"), "fault", F.lit(None).cast("long").alias("rows"))
    right = rows.groupBy(F.concat(F.lit("part-"), "c_nationkey").alias("path")).agg(F.count(F.lit(1)).alias("rows")).select("path", F.lit(None).cast("string").alias("fault"), "rows")
    return wrong.unionByName(right)


_PROGRAM = {
    "type": "object",
    "required": ["id", "title", "status", "ages"],
    "additionalProperties": False,
    "properties": {
        "id": {"type": "string", "pattern": "^p[0-9]+$"},
        "title": {"type": "string", "minLength": 3, "maxLength": 9},
        "status": {"enum": ["open", "closed", None]},
        "ages": {"type": "array", "minItems": 1, "items": {"$ref": "#/$defs/age"}},
        "size": {"type": ["integer", "null"], "minimum": 1, "maximum": 40},
    },
    "$defs": {"age": {"type": "object", "required": ["low"], "properties": {"low": {"type": "integer", "minimum": 10}, "high": {"type": ["number", "null"]}}}},
}


@_query("""WITH p AS (SELECT p_partkey AS k, p_name AS t, p_size AS s, p_retailprice AS r, p_partkey % 4 AS a, p_partkey % 5 AS b, p_partkey % 7 AS c, p_partkey % 3 AS e FROM part)
SELECT k AS id, concat_ws(',', CASE WHEN e = 1 THEN '$.ages:required' END, CASE WHEN c = 3 THEN '$.more:additionalProperties' END, CASE WHEN a = 1 THEN '$.id:pattern' WHEN a = 2 THEN '$.id:type' END, CASE WHEN length(t) < 3 THEN '$.title:minLength' END, CASE WHEN length(t) > 9 THEN '$.title:maxLength' END,
  CASE WHEN b = 2 THEN '$.status:enum' END, CASE WHEN e = 2 AND c = 0 THEN '$.ages:minItems' END, CASE WHEN e = 0 AND s < 10 THEN '$.ages[0].low:minimum' END, CASE WHEN e = 0 AND b = 0 THEN '$.ages[1]:type' END, CASE WHEN e = 2 AND c <> 0 THEN '$.ages[0].low:required' END, CASE WHEN e = 2 AND c <> 0 AND a = 3 THEN '$.ages[0].high:type' END,
  CASE WHEN s > 40 THEN '$.size:maximum' END) AS faults FROM p""")
def schema_faults(spark, d):
    """Objects written out from parts, most of them wrong in one way or several, against a schema."""
    k, n = F.col("p_partkey"), F.col("p_size").cast("string")
    a, b, c, e = k % 4, k % 5, k % 7, k % 3
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    ages = F.when(e == 0, F.concat(F.lit('[{"low":'), n, F.lit(',"high":1.5}'), F.when(b == 0, ",[]").otherwise(""), F.lit("]"))).otherwise(F.when(c == 0, "[]").otherwise(F.concat(F.lit('[{"high":'), F.when(a == 3, '"x"').otherwise("null"), F.lit("}]"))))
    ids = F.when(a == 1, quoted(F.concat(F.lit("q"), k))).when(a == 2, k.cast("string")).otherwise(quoted(F.concat(F.lit("p"), k)))
    status = F.when(b == 2, '"gone"').when(b == 3, "null").otherwise('"open"')
    text = F.concat(F.lit('{"id":'), ids, F.lit(',"title":'), quoted(F.col("p_name")), F.lit(',"status":'), status, F.lit(',"size":'), n, F.when(e != 1, F.concat(F.lit(',"ages":'), ages)).otherwise(""), F.when(c == 3, ',"more":{}').otherwise(""), F.lit("}"))
    found = schema.faults(F.parse_json(text), _PROGRAM)
    # A small file is one split, so the rows are dealt out before they are checked.
    return table(spark, d, "part").repartition(4 * spark.sparkContext.defaultParallelism).select(k.alias("id"), F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["path"], x["code"])), ",").alias("faults"))


@_query("""WITH r AS (SELECT sha256('{"k":' || o_orderkey || '}') AS k, sha256('{"c":' || o_custkey || ',"k":' || o_orderkey || ',"s":"' || o_orderstatus || '"}') AS h FROM orders),
l AS (SELECT substr(k, 1, 4) AS part, sha256(string_agg(h, chr(10) ORDER BY h)) AS sha256, count(*) AS rows FROM r GROUP BY 1),
m AS (SELECT substr(part, 1, 1) AS part, sha256(string_agg(part || ':' || sha256, chr(10) ORDER BY part)) AS sha256, sum(rows) AS rows FROM l GROUP BY 1),
t AS (SELECT '' AS part, sha256(string_agg(part || ':' || sha256, chr(10) ORDER BY part)) AS sha256, sum(rows) AS rows FROM m)
SELECT CAST(0 AS INT) AS level, part, sha256, CAST(rows AS BIGINT) AS rows FROM t UNION ALL SELECT 1, part, sha256, CAST(rows AS BIGINT) FROM m UNION ALL SELECT 4, part, sha256, rows FROM l""")
def release_tree(spark, d):
    """Hashes of orders as a release: parts of four digits, their parents, and the root."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_orderstatus").alias("s"))
    return release.tree(rows, ["k"], 4)
