"""Mixing sources to target weights by pivotal dependent rounding.

Each source has a weight and should make up that share of the mix's words; a source can be repeated ``most`` times at
most, and what it can't take is reshared among the others by weight until none is above. A document of a source with
target T and S words is wanted T / S times: the whole part is taken, the fraction is a copy probability, and the
fractions are rounded so that the source's words stay at their target.

*Rounding.* Two fractional documents trade words: one's probability rises, the other's falls, by the same number of
words, until one of the two is 0 or 1. Which way goes is drawn so that probabilities keep their mean. One fractional
document is left and trades with the next. Blocks of about ``block`` documents are gone through in this way, the largest
first; what is left of a block goes up a tree of blocks, a level a job, until a source has one fractional document left,
whose rounding is the only departure from the target. So that this one is small, documents of over 1 / ``heads`` of their
source (``heads`` of them at most) come before, the largest first: each trades with the pool of all smaller documents of its
source, whose probabilities all move together, until it is 0 or 1 itself. Where the pool cannot bear one of the two ways,
the other is taken. So the document whose rounding departs from the target is among the smallest, in a source of a few
documents as well. Draws are hashes of the rows, so reruns agree.

Equal rows (id, source, size) are one entry whose copies are dealt evenly, so many repeats of a row are no hot block.
Blocks are by hash within a source, so a source with a third of all rows has more blocks, not larger ones. Entries are told
apart by 128 bits. Targets are settled in one task, from a row of some 100 bytes a source.

Null texts have no words. Null sources are a source, last in order; so is the empty one, first. Documents without words
take no part in the rounding and get the whole part of the factor plus a copy drawn by the fraction. Null ids are allowed. A
source without words has target 0 and factor 1. An empty table gives an empty result. Other columns pass through ``mix``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightweir.session import cut

WEIGHTS = (1.0, 2.0, 3.0)


def word_count(text: Column) -> Column:
    """Runs of characters that are not ASCII white space: characters that follow white space or begin the text."""
    flat = F.trim(F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     "))
    return F.when(flat == "", 0).otherwise(F.size(F.split(flat, " +"))).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """(source, source_size, n, target): sizes has (source, size); one row a source.

    Sources in order of code points (the order of their UTF-8 bytes), null last, take the weights in turn."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    # From here on there is a row a source.
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1)).withColumn("cap", most * F.col("source_size"))
    # Sources reach their cap in order of cap / weight as the common level rises; the level that uses up all words decides.
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    all_words = F.sum("source_size").over(Window.partitionBy())
    per = per.withColumn("level", (all_words - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    free = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(Window.partitionBy())
    return per.select("source", "source_size", "n", F.coalesce(F.least(free["level"] * F.col("weight"), "cap"), F.col("cap")).alias("target"))


def _draw(*cols: Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 53)) / float(1 << 53)


def _level(entries: DataFrame, salt: int) -> DataFrame:
    """entries (src, block, key, p, s): a row a block, with what is settled in it and the entry left over."""
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("s")).alias("o"), "key", "p", "s", _draw(F.lit(salt), "key").alias("u"))))
    blocks = entries.groupBy("src", "block").agg(ordered.alias("all"))

    def step(acc: Column, x: Column) -> Column:
        c = acc["left"]
        up = F.least((1 - c["p"]) * c["s"], x["p"] * x["s"])
        down = F.least(c["p"] * c["s"], (1 - x["p"]) * x["s"])
        rise = x["u"] * (up + down) < down
        # Whichever reaches 0 or 1 is settled, the other goes on.
        c_first = F.when(rise, (1 - c["p"]) * c["s"] <= x["p"] * x["s"]).otherwise(c["p"] * c["s"] <= (1 - x["p"]) * x["s"])
        c_rest = F.when(rise, c["p"] + up / c["s"]).otherwise(c["p"] - down / c["s"])
        x_rest = F.when(rise, x["p"] - up / x["s"]).otherwise(x["p"] + down / x["s"])
        clip = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
        one = F.when(c_first, F.struct(c["key"].alias("key"), rise.cast("int").alias("more"))).otherwise(F.struct(x["key"].alias("key"), (~rise).cast("int").alias("more")))
        left = F.when(c_first, F.struct(x["key"].alias("key"), clip(x_rest).alias("p"), x["s"].alias("s"))).otherwise(F.struct(c["key"].alias("key"), clip(c_rest).alias("p"), c["s"].alias("s")))
        return F.struct(left.alias("left"), F.concat(acc["done"], F.array(one)).alias("done"))

    first = F.struct(F.col("all")[0]["key"].alias("key"), F.col("all")[0]["p"].alias("p"), F.col("all")[0]["s"].alias("s"))
    start = F.struct(first.alias("left"), F.expr("CAST(array() AS array<struct<key: struct<a: bigint, b: bigint>, more: int>>)").alias("done"))
    return blocks.select("src", "block", F.aggregate(F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0))), start, step).alias("r")).select("src", "block", "r.left", "r.done")


def _heads(entries: DataFrame, pool: DataFrame, salt: int) -> DataFrame:
    """entries (src, key, p, s), a few a source, and pool (src, s0, s1: words and wanted words of all entries of the source):
    (src, done, a, b), with p * a + b for what is wanted of the others then."""
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("s")).alias("o"), "key", "p", "s", _draw(F.lit(salt), "key").alias("u"))))
    rows = entries.groupBy("src").agg(ordered.alias("all")).join(pool, "src")
    zero = F.lit(0.0)

    def step(acc: Column, x: Column) -> Column:
        s0, s1 = acc["s0"] - x["s"], acc["s1"] - x["p"] * x["s"]
        p = F.least(F.greatest(acc["a"] * x["p"] + acc["b"], zero), F.lit(1.0))
        down = F.greatest(acc["a"] * s1 + acc["b"] * s0, zero)
        return F.struct(s0.alias("s0"), s1.alias("s1"), acc["a"].alias("a"), acc["b"].alias("b"), acc["done"].alias("done"), x["key"].alias("key"), x["u"].alias("u"), p.alias("p"), ((1 - p) * x["s"]).alias("up_by"), (p * x["s"]).alias("down_by"), down.alias("down"), F.greatest(s0 - down, zero).alias("up"))

    def traded(t: Column) -> Column:
        can_rise, can_fall = t["up_by"] <= t["down"] + 1e-6, t["down_by"] <= t["up"] + 1e-6
        rise = F.when(can_rise & can_fall, t["u"] < t["p"]).when(can_rise | can_fall, can_rise).otherwise(t["up_by"] - t["down"] < t["down_by"] - t["up"])
        given = F.when(rise, F.when(t["down"] > 0, F.least(t["up_by"] / t["down"], F.lit(1.0)))).otherwise(F.when(t["up"] > 0, F.least(t["down_by"] / t["up"], F.lit(1.0))))
        k = F.coalesce(given, zero)
        one = F.array(F.struct(t["key"].alias("key"), rise.cast("int").alias("more")))
        return F.struct(t["s0"].alias("s0"), t["s1"].alias("s1"), (t["a"] * (1 - k)).alias("a"), (t["b"] * (1 - k) + F.when(rise, zero).otherwise(k)).alias("b"), F.concat(t["done"], one).alias("done"))

    none = F.expr("CAST(array() AS array<struct<key: struct<a: bigint, b: bigint>, more: int>>)")
    start = F.struct(F.col("s0"), F.col("s1"), F.lit(1.0).alias("a"), zero.alias("b"), none.alias("done"))
    # The trade is an array's element, so that what it reads is computed once.
    found = rows.select("src", F.aggregate("all", start, lambda acc, x: F.transform(F.array(step(acc, x)), traded)[0]).alias("r"))
    return found.select("src", "r.done", "r.a", "r.b")


def copies(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0, seed: int = 0, block: int = 128, heads: int = 400) -> DataFrame:
    """sizes (id, source, size): (id, source, size, c, source_size, target, extra); a row for each different (id, source,
    size), c equal rows that are taken extra times in all."""
    spark = sizes.sparkSession
    entries = cut(sizes.groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("c")))
    targets = cut(source_targets(entries.select("source", "size", "c").withColumn("size", F.col("size") * F.col("c")), weights, most))
    n_sources, largest = targets.agg(F.count(F.lit(1)), F.max("n")).first()
    per = targets.withColumn("src", F.xxhash64("source")).withColumn("factor", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(1.0))
    per = per.select(F.col("source").alias("of"), "src", "n", "factor", "source_size", "target")
    if n_sources <= 10_000:  # some 100 bytes each
        per = F.broadcast(per)
    placed = entries.join(per, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    wanted = F.col("factor") * F.col("c")
    whole = F.floor(wanted + 1e-9)
    placed = placed.withColumn("key", F.struct(F.xxhash64(F.lit(seed), "id", "source", "size").alias("a"), F.xxhash64(F.lit(seed + 1), "size", "source", "id").alias("b"))).withColumn("whole", whole).withColumn("p", F.greatest(wanted - whole, F.lit(0.0)))
    part = placed.where("size > 0 AND p > 1e-9").select("src", "n", "key", "p", F.col("size").cast("double").alias("s"), (F.col("size") * F.lit(heads) > F.col("source_size")).alias("head"))
    block_of = F.pmod(F.xxhash64(F.lit(seed), "key"), F.ceil(F.col("n") / block))
    # Keys settled as taken once more; all others are not.
    pool = part.groupBy("src").agg(F.sum("s").alias("s0"), F.sum(F.col("p") * F.col("s")).alias("s1"))
    first = cut(_heads(part.where("head"), pool, seed * 1000 + 999))
    settled = [first.select(F.explode("done").alias("d")).select("d.key", "d.more")]
    moved = first.select("src", "a", "b")
    light = part.where("NOT head").join(F.broadcast(moved) if n_sources <= 10_000 else moved, "src", "left")
    p = F.least(F.greatest(F.coalesce(F.col("p") * F.col("a") + F.col("b"), F.col("p")), F.lit(0.0)), F.lit(1.0))
    part = light.select("src", block_of.alias("block"), "key", p.alias("p"), "s")
    blocks = max(1, math.ceil((largest or 0) / block))
    for depth in range(99):
        done = cut(_level(part, seed * 1000 + depth))
        settled.append(done.select(F.explode("done").alias("d")).select("d.key", "d.more"))
        left = done.select("src", "block", "left.key", "left.p", "left.s")
        if blocks == 1:
            settled.append(left.select("key", (_draw(F.lit(seed), F.lit(-1), "key") < F.col("p")).cast("int").alias("more")))
            break
        part, blocks = left.withColumn("block", F.floor(F.col("block") / block)), math.ceil(blocks / block)
    more = settled[0]
    for s in settled[1:]:
        more = more.unionByName(s)
    more = more.where("more = 1").select("key", "more")
    empty = F.when((F.col("size") == 0) & (_draw(F.lit(seed), F.lit(-2), "key") < F.col("p")), 1).otherwise(0)
    out = placed.join(more, "key", "left").withColumn("extra", (F.col("whole") + F.coalesce("more", F.lit(0)) + empty).cast("long"))
    return out.select("id", "source", "size", "c", "source_size", "target", "extra")


def _dealt(nth: Column) -> Column:
    """How often the nth of c equal rows is taken."""
    return (F.floor(F.col("extra") / F.col("c")) + (nth <= F.col("extra") % F.col("c")).cast("long")).cast("long")


def mix_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """One row per row of docs: id, size, source_size, target, copies, taken (words, repeats counted)."""
    sizes = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    rows = copies(cut(sizes), **settings).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("c"))))
    rows = rows.withColumn("copies", _dealt(F.col("nth")))
    return rows.select(F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; columns as they were."""
    own = docs.withColumns({"__size": word_count(F.col(text_col)), "__row": F.xxhash64(id_col, source_col)})
    table = copies(cut(own.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col("__size").alias("size"))), **settings)
    # Rows that are there once, the usual case, need no order among equals.
    table = table.where("extra > 0 OR c > 1").select(F.xxhash64("id", "source").alias("__row"), F.col("id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__n"), "c", "extra")
    same = (own["__row"] == table["__row"]) & own[id_col].eqNullSafe(table["__id"]) & own[source_col].eqNullSafe(table["__source"]) & (own["__size"] == table["__n"])
    met = own.join(table, same).select(*(own[c] for c in docs.columns), own["__row"].alias("__k"), "__n", table["c"].alias("__c"), table["extra"].alias("__extra"))
    taken = met.where("__c = 1").withColumn("__times", F.col("__extra"))
    if not table.where("c > 1").isEmpty():
        # Rows that are alike in all columns are one variant with a count; variants are put in order by their hash.
        rows = met.where("__c > 1").withColumn("__hash", F.struct(F.xxhash64(*docs.columns), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
        variants = rows.groupBy("__k", "__n", "__c", "__extra", "__hash").agg(F.count(F.lit(1)).alias("__m"), *[F.any_value(c).alias(c) for c in docs.columns])
        before = F.sum("__m").over(Window.partitionBy("__k", id_col, source_col, "__n").orderBy("__hash").rowsBetween(Window.unboundedPreceding, -1))
        left = F.col("__extra") % F.col("__c") - F.coalesce(before, F.lit(0))
        times = F.floor(F.col("__extra") / F.col("__c")) * F.col("__m") + F.least(F.greatest(left, F.lit(0)), F.col("__m"))
        taken = taken.unionByName(variants.withColumn("__times", times).select(*taken.columns))
    return taken.where("__times > 0").withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times").cast("long")))).select(*docs.columns)


def op2(spark, sf_dir: str) -> DataFrame:
    from brightweir.session import table

    return mix_table(table(spark, sf_dir, "documents"))
