"""Persisted postings of one to three letters, so that a substring search reads the rows that can match and not all of them.

A gram's ids are kept sorted in blocks of a bounded range of ids, and grams are dealt to buckets, which are folders: a search
reads the buckets of the grams it asks for. Of the grams of a search the rarest one is read, and whoever searches looks the
texts of what is found over again, so that postings may hold ids whose text has changed since: an update adds the grams of
changed rows as a generation of its own and rewrites nothing. The empty gram stands for every row.

Null texts count as empty, repeated ids as one. Ids are whole numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK, BUCKETS, SPREAD = 1 << 16, 64, 16
LONGEST = 3
#: What LIKE reads as more than itself.
WILD = r"[%_\\]"


def grams(text: Column) -> Column:
    """All runs of one to three characters of a text in lower case, and the empty one."""
    low = F.lower(F.coalesce(text, F.lit("")))
    runs = [F.regexp_extract_all(low, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in range(1, LONGEST + 1)]
    return F.array_distinct(F.concat(F.array(F.lit("")), *runs))


def asked_grams(term: Column) -> Column:
    """The grams that a text with the term must have: of each part between wildcards those of three characters, or the part itself."""
    parts = F.filter(F.split(F.lower(term), WILD + "+"), lambda x: x != "")
    return F.flatten(F.transform(parts, lambda p: F.when(F.char_length(p) <= LONGEST, F.array(p)).otherwise(F.regexp_extract_all(p, F.lit(f"(?s)(?=(.{{{LONGEST}}}))"), F.lit(1)))))


def add(rows: DataFrame, path: str, fields: list[str], generation: int, id_col: str = "id") -> None:
    """Write the grams of rows as a generation; the same generation again replaces what it wrote before."""
    every = F.array_distinct(F.flatten(F.array(*[grams(F.col(f)) for f in fields])))
    posts = rows.select(F.col(id_col).cast("long").alias("id"), F.explode(every).alias("gram"))
    blocks = posts.groupBy("gram", F.floor(F.col("id") / BLOCK).alias("block")).agg(F.sort_array(F.collect_set("id")).alias("ids"))
    placed = blocks.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(BUCKETS)).cast("int")).repartition("bucket", F.col("block") % SPREAD)
    placed.sortWithinPartitions("bucket", "gram", "block").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/posts/generation={generation}")
    kept = rows.sparkSession.read.parquet(f"{path}/posts/generation={generation}")
    kept.groupBy("gram").agg(F.sum(F.size("ids")).alias("n")).write.mode("overwrite").parquet(f"{path}/sizes/generation={generation}")


def rarest(spark: SparkSession, path: str, needles: DataFrame) -> DataFrame:
    """needles (needle, terms: array of strings that must all occur): (needle, gram, n), the rarest gram that the terms ask for."""
    asked = needles.select("needle", F.explode(F.array_union(F.array(F.lit("")), F.flatten(F.transform("terms", asked_grams)))).alias("gram"))
    sizes = spark.read.parquet(f"{path}/sizes").groupBy("gram").agg(F.sum("n").alias("n"))
    best = asked.join(sizes, "gram", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), (-F.length("gram")).alias("l"), "gram")).alias("b"))
    return best.select("needle", "b.gram", "b.n")


def read(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(gram, block, ids) of the grams of a table, from their buckets alone; at most ``BUCKETS`` numbers come to the driver."""
    buckets = [r[0] for r in wanted.select(F.pmod(F.xxhash64("gram"), F.lit(BUCKETS)).cast("int")).distinct().collect()]
    return spark.read.parquet(f"{path}/posts").where(F.col("bucket").isin(buckets)).select("gram", "block", "ids")


def candidates(spark: SparkSession, path: str, needles: DataFrame, unique: bool = True) -> DataFrame:
    """(needle, id): every row whose text can have all terms of a needle, and some that haven't; each once if ``unique``."""
    best = rarest(spark, path, needles).where("n > 0").select("needle", "gram")
    found = best.join(read(spark, path, best), "gram").select("needle", F.explode("ids").alias("id"))
    return found.distinct() if unique else found


def holds(fields: list[Column], term: Column) -> Column:
    """Whether a term occurs in one of the fields, in any case; wildcards work as in LIKE."""
    low = [F.lower(F.coalesce(f, F.lit(""))) for f in fields]
    plain, wild = F.lit(False), F.lit(False)
    for f in low:
        plain = plain | F.contains(f, F.lower(term))
        wild = wild | F.call_function("like", f, F.concat(F.lit("%"), F.lower(term), F.lit("%")))
    return F.when(term.rlike(WILD), wild).otherwise(plain)


def search(rows: DataFrame, path: str, needles: DataFrame, fields: list[str], id_col: str = "id") -> DataFrame:
    """(needle, id): rows with all terms of a needle, each in one of the fields."""
    found = candidates(rows.sparkSession, path, needles).join(needles, "needle")
    pairs = found.join(rows.select(F.col(id_col).alias("id"), *[F.col(f).alias(f"__{f}") for f in fields]), "id")
    return pairs.where(F.forall("terms", lambda t: holds([F.col(f"__{f}") for f in fields], t))).select("needle", "id")
