"""Three-valued predicates: match, mismatch or unknown as strings; null means that the dimension was not asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightweir.session import cut

#: Fixed value: what an age condition without a limit says.
NO_LIMIT = "제한 없음"


def age(value: Column, low: Column, high: Column, text: Column | None = None) -> Column:
    """Bounds 0 and 0 are a placeholder for none; without bounds the answer is unknown unless the text says there is no limit."""
    blank = F.coalesce((low == 0) & (high == 0), F.lit(False))
    low, high = F.when(~blank, low), F.when(~blank, high)
    verdict = F.when(value.isNull(), F.lit(None).cast("string")).when((value < low) | (value > high), "mismatch").when(low.isNotNull() | high.isNotNull(), "match")
    if text is not None:
        verdict = verdict.when(F.regexp_replace(text, r"(?U)\s+", " ").contains(NO_LIMIT), "match")
    return verdict.otherwise("unknown")


def status(have: Column, want: Column | str | None) -> Column:
    if want is None:
        return F.lit(None).cast("string")
    asked = F.when(want.isNull(), F.lit(None).cast("string")) if isinstance(want, Column) else F
    return asked.when(have.isNull(), "unknown").when(have == want, "match").otherwise("mismatch")


def category(have: Column, want: Column | str | None) -> Column:
    """have: array of categories."""
    if want is None:
        return F.lit(None).cast("string")
    asked = F.when(want.isNull(), F.lit(None).cast("string")) if isinstance(want, Column) else F
    return asked.when(F.coalesce(F.size(have), F.lit(0)) <= 0, "unknown").when(F.array_contains(have, want), "match").otherwise("mismatch")


def edges(nodes: DataFrame) -> DataFrame:
    """nodes (code, parent, aggregate_parent): (code, parent), a row for each of the two pointers that is set."""
    return nodes.select("code", F.explode(F.array_compact(F.array_distinct(F.array("parent", "aggregate_parent")))).alias("parent"))


def closure(nodes: DataFrame) -> DataFrame:
    """nodes (code, parent): (code, ancestor, distance), distance 0 included, to whatever depth the tree has.

    A join a level, until a level has no rows; a code that meets itself on the way is an error. With a column
    aggregate_parent, that pointer is preferred."""
    parent = F.coalesce("aggregate_parent", "parent") if "aggregate_parent" in nodes.columns else F.col("parent")
    up = cut(nodes.select(F.col("code").alias("ancestor"), parent.alias("parent")).where("parent IS NOT NULL"))
    found = level = nodes.select("code", F.col("code").alias("ancestor"), F.lit(0).alias("distance"))
    for d in range(1, 1 << 30):
        level = cut(level.join(up, "ancestor").select("code", F.col("parent").alias("ancestor"), F.lit(d).alias("distance")))
        some, loops = level.agg(F.count(F.lit(1)), F.count_if(F.col("code") == F.col("ancestor"))).first()
        if loops:
            raise ValueError("the tree has a cycle")
        if not some:
            return found
        found = found.unionByName(level)


def region(policies: DataFrame, rules: DataFrame, tree: DataFrame, query: str | None, state: str = "matched", province: str | None = None) -> DataFrame:
    """(policy, verdict, reason) for the region with code ``query``; state: matched, unmapped or ambiguous.

    policies (policy, scope: nationwide, regional, unknown or null), rules (policy, relation, code, and where they are
    there resolution, region_status, province), tree from ``closure``. Nationwide matches whatever was asked; exclusion on
    the query's path beats inclusion; an include on the path is exact or an ancestor, one below it a descendant. Rules that
    aren't resolved to an active region leave the answer unknown unless they are known to be of another province."""
    path = tree.where(F.col("code") == query).select(F.col("ancestor").alias("code"), F.col("distance").alias("above"))
    if state == "matched" and (query is None or path.isEmpty()):
        state = "unmapped"
    below = tree.where((F.col("ancestor") == query) & (F.col("distance") > 0)).select("code", F.col("distance").alias("under"))
    default = {"resolution": "matched", "region_status": "active", "province": None}
    rules = rules.withColumns({c: F.lit(v).cast("string") for c, v in default.items() if c not in rules.columns})
    usable = F.coalesce((F.col("resolution") == "matched") & F.col("code").isNotNull() & (F.col("region_status") == "active"), F.lit(False))
    relevant = ~usable & (F.lit(province is None) | F.col("province").isNull() | (F.col("province") == F.lit(province)))
    include, exclude = usable & (F.col("relation") == "include"), usable & (F.col("relation") == "exclude")
    per = (
        rules.join(path, "code", "left")
        .join(below, "code", "left")
        .groupBy("policy")
        .agg(
            F.count_if(exclude & F.col("above").isNotNull()).alias("shut"),
            F.min(F.when(include, F.col("above"))).alias("near"),
            F.min(F.when(include, F.col("under"))).alias("deep"),
            F.count_if(include).alias("includes"),
            F.count_if(relevant).alias("open_questions"),
        )
    )
    kinds = (
        F.when(F.col("scope") == "nationwide", "match/nationwide")
        .when(F.coalesce(F.col("scope"), F.lit("unknown")) == "unknown", "unknown/policy_unknown")
        .when(F.lit(state != "matched"), f"unknown/query_{state}")
        .when(F.col("shut") > 0, "mismatch/exclude")
        .when(F.col("near") == 0, "match/exact")
        .when(F.col("near") > 0, "match/ancestor")
        .when(F.col("deep") > 0, "match/descendant")
        .when((F.coalesce("includes", F.lit(0)) == 0) | (F.col("open_questions") > 0), "unknown/unresolved_rule")
        .otherwise("mismatch/other_region")
    )
    both = F.split(kinds, "/")
    return policies.join(per, "policy", "left").select("policy", both[0].alias("verdict"), both[1].alias("reason"))


def intervals(nodes: DataFrame) -> DataFrame:
    """nodes (code, parent): (code, lo, hi, depth); a code is another one or below it where its lo lies within the other's lo
    and hi. In a walk around the tree every code is entered and left once, and each step names the next one. How far a step
    is from the end is found by doubling, in as many joins as the number of steps has binary digits, however deep the tree
    is. A cycle has no end and is an error. Codes whose parent is not there are roots; null codes are left out."""
    known = nodes.where("code IS NOT NULL").select("code", "parent").distinct()
    up = known.select(F.col("code").alias("parent"), F.lit(True).alias("there"))
    known = cut(known.join(up, "parent", "left").select("code", F.when(F.col("there"), F.col("parent")).alias("parent")))
    if known.groupBy("code").count().where("count > 1").limit(1).count():
        raise ValueError("a code has several parents")
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c))
    order = Window.partitionBy("parent").orderBy("code")
    roots = F.col("parent").isNull()
    leave = known.select(name("-", "code").alias("step"), F.coalesce(F.concat(F.lit("+"), F.lead("code").over(order)), name("-", "parent")).alias("next"), F.lit(-1).alias("down"))
    # Roots are siblings: the last one's end is the end of the walk.
    first = known.where(~roots).groupBy("parent").agg(F.min("code").alias("child")).withColumnRenamed("parent", "code")
    enter = known.select("code").join(first, "code", "left").select(name("+", "code").alias("step"), F.coalesce(name("+", "child"), name("-", "code")).alias("next"), F.lit(1).alias("down"))
    walk = cut(enter.unionByName(leave).withColumn("far", F.when(F.col("next").isNotNull(), 1).otherwise(0).cast("long")).withColumn("sum", F.when(F.col("next").isNotNull(), F.col("down")).otherwise(0).cast("long")).drop("down"))
    n = walk.count()
    for _ in range(n.bit_length()):
        there = walk.select(F.col("step").alias("next"), F.col("next").alias("after"), F.col("far").alias("more"), F.col("sum").alias("deeper"))
        walk = cut(walk.join(there, "next", "left").select("step", F.col("after").alias("next"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"), (F.col("sum") + F.coalesce("deeper", F.lit(0))).alias("sum")))
    if walk.where("next IS NOT NULL").limit(1).count():
        raise ValueError("the tree has a cycle")
    # The walk's last step counts for nothing, so steps from entering a code to the end sum up to 1 less its depth.
    at = walk.select(F.substring("step", 2, 1 << 30).alias("code"), F.substring("step", 1, 1).alias("kind"), (F.lit(n) - F.col("far")).alias("at"), "sum")
    on = F.col("kind") == "+"
    return at.groupBy("code").agg(F.max(F.when(on, F.col("at"))).alias("lo"), F.max(F.when(~on, F.col("at"))).alias("hi"), F.max(F.when(on, 1 - F.col("sum"))).alias("depth"))


def regions(pairs: DataFrame, policies: DataFrame, rules: DataFrame, tree: DataFrame) -> DataFrame:
    """(region, policy, verdict, reason, evidence) for each pair (region, policy): as ``region`` says for one region, for as many
    as a table has. tree: from ``intervals``. evidence: the rule that decided, the least by distance, scheme, code and text
    (struct<distance, scheme, code, text, relation>); null where none did.

    pairs may name a province a region belongs to (province); a region that isn't in the tree is unmapped. rules may have
    scheme and text besides the columns that ``region`` reads."""
    default = {"resolution": "matched", "region_status": "active", "province": None, "scheme": None, "text": None}
    rules = rules.withColumns({c: F.lit(v).cast("string") for c, v in default.items() if c not in rules.columns})
    asked = pairs.select("region", "policy", (F.col("province") if "province" in pairs.columns else F.lit(None).cast("string")).alias("asked_province")).where("region IS NOT NULL").distinct()
    asked = asked.join(tree.select(F.col("code").alias("region"), F.col("lo").alias("q_lo"), F.col("hi").alias("q_hi"), F.col("depth").alias("q_depth")), "region", "left")
    placed = rules.join(tree.select("code", "lo", "hi", "depth"), "code", "left")
    usable = F.coalesce((F.col("resolution") == "matched") & F.col("code").isNotNull() & (F.col("region_status") == "active"), F.lit(False))
    relevant = ~usable & (F.col("asked_province").isNull() | F.col("province").isNull() | (F.col("province") == F.col("asked_province")))
    include, exclude = usable & (F.col("relation") == "include"), usable & (F.col("relation") == "exclude")
    above = F.col("q_lo").between(F.col("lo"), F.col("hi"))
    below = F.col("lo").between(F.col("q_lo"), F.col("q_hi")) & ~above
    near = F.abs(F.col("q_depth") - F.col("depth")).cast("int")
    told = F.struct(near.alias("distance"), "scheme", "code", "text", "relation")
    per = (
        asked.join(placed, "policy")
        .groupBy("region", "policy")
        .agg(
            F.min(F.when(exclude & above, told)).alias("shut"),
            F.min(F.when(include & above, told)).alias("near"),
            F.min(F.when(include & below, told)).alias("deep"),
            F.count_if(include).alias("includes"),
            F.count_if(relevant).alias("open_questions"),
        )
    )
    rows = asked.join(per, ["region", "policy"], "left").join(policies.select("policy", "scope"), "policy")
    kinds = (
        F.when(F.col("scope") == "nationwide", "match/nationwide")
        .when(F.coalesce(F.col("scope"), F.lit("unknown")) == "unknown", "unknown/policy_unknown")
        .when(F.col("q_lo").isNull(), "unknown/query_unmapped")
        .when(F.col("shut").isNotNull(), "mismatch/exclude")
        .when(F.col("near.distance") == 0, "match/exact")
        .when(F.col("near").isNotNull(), "match/ancestor")
        .when(F.col("deep").isNotNull(), "match/descendant")
        .when((F.coalesce("includes", F.lit(0)) == 0) | (F.col("open_questions") > 0), "unknown/unresolved_rule")
        .otherwise("mismatch/other_region")
    )
    both = F.split(kinds, "/")
    evidence = F.when(both[1] == "exclude", F.col("shut")).when(both[1].isin("exact", "ancestor"), F.col("near")).when(both[1] == "descendant", F.col("deep"))
    return rows.select("region", "policy", both[0].alias("verdict"), both[1].alias("reason"), evidence.alias("evidence"))
