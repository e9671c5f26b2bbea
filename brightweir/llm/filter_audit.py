"""Which filter removes what, in every order of the filters: a packed bitmap index of each partition.

Each partition lays its rows out by part in runs of whole 64-bit words and keeps one NumPy bitset for each filter, for each
label and for the rows themselves (a part's bitset is its run of these). For every subset of the filters, AND-NOT leaves what
the subset keeps and a popcount a run says how many rows, and how many of each label, these are. Spark sums the counts of
the partitions, a row for each part and subset; all that is asked about an order of filters follows from the counts of its
prefixes. Work grows with rows times subsets, not with parts or orders, and no task holds more than ``CHUNK`` rows.

Null texts count as empty, null parts as the empty string. Repeated rows count each. A null id is in no order with others: it
is never a later copy and never an earlier one, and has no labels. Labels of a repeated id count if any of its rows says so.
Empty tables give no rows. Columns other than id, text and part take no part.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightweir.operators.audit import met
from brightweir.session import cut, table

CHUNK = 1 << 17


def subset_counts(rows: DataFrame, filters: list[str], labels: list[str]) -> DataFrame:
    """(part, subset, kept, and a count for each label): rows that fail no filter of the subset (bit i for filters[i]), by part.

    rows has a string column part and boolean columns of the names given."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            yield _count_chunk(chunk, filters, labels)

    sums = ["kept", *labels]
    found = rows.select("part", *filters, *labels).mapInArrow(counted, "part string, subset int, " + ", ".join(f"`{c}` long" for c in sums))
    return found.groupBy("part", "subset").agg(*[F.sum(c).alias(c) for c in sums])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        if n and n + batch.num_rows > CHUNK:
            yield pa.Table.from_batches(held)
            held, n = [], 0
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def _count_chunk(chunk: pa.Table, filters: list[str], labels: list[str]) -> pa.RecordBatch:
    part = chunk["part"].combine_chunks().dictionary_encode()
    codes = part.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    size = np.bincount(codes, minlength=len(part.dictionary))
    words = (size + 63) // 64
    run = np.cumsum(words) - words  # the first word of each part
    place = np.repeat(run * 64 - (np.cumsum(size) - size), size) + np.arange(len(codes))

    def bitset(flags: np.ndarray) -> np.ndarray:
        bits = np.zeros(int(words.sum()) * 64, bool)
        bits[place] = flags[order]
        return np.packbits(bits, bitorder="little").view(np.uint64)

    fails = [bitset(chunk[f].to_numpy()) for f in filters]
    masks = [bitset(chunk[c].to_numpy()) for c in labels]
    kept = [bitset(np.ones(len(codes), bool))]
    for subset in range(1, 1 << len(filters)):
        low = (subset & -subset).bit_length() - 1
        kept.append(kept[subset & (subset - 1)] & ~fails[low])

    def counts(sets: list[np.ndarray]) -> pa.Array:
        """By part, then by subset."""
        return pa.array(np.stack([np.add.reduceat(np.bitwise_count(s), run, dtype=np.int64) for s in sets], axis=1).ravel())

    n = len(part.dictionary)
    columns = {"part": part.dictionary.take(pa.array(np.repeat(np.arange(n), len(kept)))), "subset": pa.array(np.tile(np.arange(len(kept), dtype=np.int32), n)), "kept": counts(kept)}
    for name, mask in zip(labels, masks, strict=True):
        columns[name] = counts([s & mask for s in kept])
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def order_report(counts: DataFrame, filters: list[str], labels: list[str]) -> DataFrame:
    """A row for each part, order of the filters and step: filter, kept, removed, redundant, unique_fails, <label>_lost, shapley.

    shapley is what the filter removes, summed over all orders: a subset before it stands in as many orders as the rest of the
    filters can be arranged around both."""
    n = len(filters)
    every = (1 << n) - 1
    steps = []
    for order in itertools.permutations(range(n)):
        before = 0
        for step, f in enumerate(order, 1):
            steps.append(("".join(filters[i] for i in order), step, filters[f], 1 << f, before))
            before |= 1 << f
    orders = counts.sparkSession.createDataFrame(steps, "filter_order string, step int, filter string, bit int, before int")
    sums = ["kept", *labels]
    by_part = counts.groupBy("part").agg(*[F.sort_array(F.collect_list(F.struct("subset", c))).alias(f"a_{c}") for c in sums])
    by_part = by_part.select("part", *[F.col(f"a_{c}")[c].alias(f"a_{c}") for c in sums])
    shapley = [sum((_count("kept", s) - _count("kept", s | 1 << f)) * (math.factorial(k) * math.factorial(n - 1 - k)) for s in range(1 << n) if not s >> f & 1 for k in [s.bit_count()]) for f in range(n)]
    by_part = by_part.withColumn("shapley", F.create_map(*[x for f in range(n) for x in (F.lit(filters[f]), shapley[f])]))
    prefix = by_part.withColumn("before", F.explode(F.sequence(F.lit(0), F.lit(every))))
    # every order's rows: a table of n * n! rows, whatever the data
    r = prefix.join(F.broadcast(orders), "before")
    after = F.col("before").bitwiseOR(F.col("bit"))
    removed = _count("kept", F.col("before")) - _count("kept", after)
    lost = [(_count(c, F.col("before")) - _count(c, after)).alias(f"{c}_lost") for c in labels]
    return r.select(
        "part",
        "filter_order",
        "step",
        "filter",
        _count("kept", after).alias("kept"),
        removed.alias("removed"),
        (_count("kept", 0) - _count("kept", F.col("bit")) - removed).alias("redundant"),
        (_count("kept", F.lit(every).bitwiseXOR(F.col("bit"))) - _count("kept", every)).alias("unique_fails"),
        *lost,
        F.col("shapley")[F.col("filter")].alias("shapley"),
    )


def _count(name: str, subset: Column | int) -> Column:
    return F.get(F.col(f"a_{name}"), subset if isinstance(subset, Column) else F.lit(subset))


def text_failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, A, B, C, D, E): under 200 words; under half of the words distinct; over 2 % capitals; a mark of ``#$%&*|``;
    the text of a smaller id again. One pass over the texts; rows of copies meet by digests, salted, without the texts."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("t"), F.array_remove(F.split(text, r"[ \t-\r]+"), "").alias("w"))
    n = F.size("w")
    narrow = cut(
        base.select(
            "doc_id",
            "part",
            F.unhex(F.sha2("t", 256)).alias("digest"),
            (n < 200).alias("A"),
            (100 * F.size(F.array_distinct("w")) < 50 * n).alias("B"),
            (100 * F.regexp_count("t", F.lit("[A-Z]")).cast("long") > 2 * F.length("t")).alias("C"),
            F.col("t").rlike(r"[#$%&*|]").alias("D"),
        )
    )
    copies = narrow.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    return met(narrow, copies, "digest").withColumn("E", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))).drop("digest", "first")


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with good and toxic; rows without an id are not dealt by it."""
    per = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("q"), F.max((F.col("toxic") == 1).cast("int")).alias("x"))
    good, toxic = F.coalesce(F.col("q") == 1, F.lit(False)).alias("good"), F.coalesce(F.col("x") == 1, F.lit(False)).alias("toxic")
    known = rows.where("doc_id IS NOT NULL").join(per, "doc_id", "left").select(*rows.columns, good, toxic)
    return known.unionByName(rows.where("doc_id IS NULL").select("*", F.lit(False).alias("good"), F.lit(False).alias("toxic")))


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The report of the five text filters over documents, by source."""
    filters, marks = list("ABCDE"), ["good", "toxic"]
    return order_report(subset_counts(labelled(text_failures(docs), labels), filters, marks), filters, marks)


def op11(spark, sf_dir: str) -> DataFrame:
    return interactions(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), table(spark, sf_dir, "labels"))


#: Rows by the letters of the filters they fail; in each order the first of these removes them.
OP11_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * len(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
  FROM d LEFT JOIN l ON l.doc_id = d.doc_id
), g AS (SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL
), o AS (
  SELECT '' AS filter_order UNION ALL
  SELECT filter_order || c FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) AS t(c) WHERE NOT contains(filter_order, c)
), p AS (
  SELECT g.*, filter_order, coalesce(list_min([instr(filter_order, x) FOR x IN string_split(fails, '') IF x <> '']), 6) AS gone
  FROM g, o WHERE len(filter_order) = 5
), r AS (
  SELECT part, filter_order, step, substr(filter_order, CAST(step AS INT), 1) AS filter,
    coalesce(sum(n) FILTER (gone > step), 0) AS kept, coalesce(sum(n) FILTER (gone = step), 0) AS removed,
    coalesce(sum(n) FILTER (gone < step AND contains(fails, substr(filter_order, CAST(step AS INT), 1))), 0) AS redundant,
    coalesce(sum(n) FILTER (fails = substr(filter_order, CAST(step AS INT), 1)), 0) AS unique_fails,
    coalesce(sum(n) FILTER (gone = step AND good), 0) AS good_lost, coalesce(sum(n) FILTER (gone = step AND toxic), 0) AS toxic_lost
  FROM p, range(1, 6) AS s(step) GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, filter, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM r
"""
