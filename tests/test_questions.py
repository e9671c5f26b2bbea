"""Many questions at once against one at a time, postings, and intervals of a tree."""

import random
import re

import pytest
from pyspark.sql import functions as F

from brightweir import session
from brightweir.operators import postings, questions, search, verdict

POLICY = "id long, title string, summary string, support_content string, categories array<string>, regions array<string>, age_min int, age_max int, age_text string, status string, quality string, scope string"
WORDS = ["청년", "월세", "지원", "Rent", "rent aid", "100%", "a_b", "집", "Straße", "ＦＵＬＬ", "교통 비", "교통비", "x"]


@pytest.fixture(scope="module")
def policies(spark):
    r = random.Random(4)
    rows = []
    for i in range(240):
        some = lambda n: " ".join(r.choice(WORDS) for _ in range(r.randint(0, n)))
        low = r.choice([None, 0, 18, 25])
        rows.append((i, some(4) or "t", r.choice([None, some(6)]), r.choice(["", some(3)]), r.sample(["housing", "finance", "other"], r.randint(0, 2)), r.choice([[], ["n1"], ["r1", "n2"], ["n9"]]), low, 0 if low == 0 else r.choice([None, 30]), r.choice([None, "연령 제한 없음"]), r.choice([None, "open", "scheduled", "closed"]), r.choice(["valid", "valid", "partial", "invalid"]), r.choice([None, "regional", "regional", "nationwide"])))
    return search.search_document(spark.createDataFrame(rows, POLICY)).cache()


@pytest.fixture(scope="module")
def tree(spark):
    return spark.createDataFrame([("world", None), ("r1", "world"), ("r2", "world"), ("n1", "r1"), ("n2", "r1"), ("n9", "r2")], "code string, parent string")


def asked():
    r = random.Random(9)
    rows = []
    for q in range(500):
        rows.append((q, [r.choice([*WORDS, "", " 월세 ", "RENT", "%t", "nothing"]) for _ in range(r.randint(1, 3))], r.choice([None, None, "청년", "월세"]), r.choice([None, None, "open", "closed"]), r.choice([None, 17, 26, 40]), r.choice([None, "housing"]), r.choice([None, "r1", "n2", "gone"]), r.choice([None, True, False]), r.choice([None, ["housing", "other"]]), r.choice([None, 20]), r.choice([None, "n1"])))
    return [x for x in rows if x[2] or any(t.strip() for t in x[1])]


def test_many_questions_are_as_single_ones(spark, policies, tree, tmp_path):
    index = f"file://{tmp_path}/postings"
    postings.add(policies, index, questions.TEXTS, 0)
    rows = asked()
    q = spark.createDataFrame(rows, "question long, terms array<string>, keyword string, status string, age int, category string, region string, include_partial boolean, wanted_categories array<string>, wanted_age int, preferred_region string")
    rules = policies.select(F.col("id").alias("policy"), F.explode("regions").alias("code"), F.lit("include").alias("relation"))
    base = policies.select(F.col("id").alias("policy"), "scope")
    # Every region with every policy, as the single runs below look at them too.
    pairs = base.select("policy", F.explode(F.array(*map(F.lit, ["r1", "n2", "gone", "n1"]))).alias("region"))
    regions = verdict.regions(pairs, base, rules, verdict.intervals(tree)).cache()
    keep = ["id", "status_verdict", "age_verdict", "category_verdict", "region_verdict", "score", "preference_matches", "preference_unknowns", "region_group", "region_breadth", "region_relation", "unknown_count", "status_rank"]
    found = questions.best(questions.answers(questions.projected(policies), q, index, regions), 1000)
    many = {}
    for r in found.orderBy("question", "rank").select("question", *keep).collect():
        many.setdefault(r.question, []).append(tuple(r)[1:])
    assert len(rows) > 480 and sum(map(len, many.values())) > 3000
    for x in rows[::35]:  # each a plan of its own
        ask = search.Request(terms=x[1], keyword=x[2], status=x[3], age=x[4], category=x[5], region=x[6], include_partial=x[7] is not False, wanted_categories=tuple(x[8] or ()), wanted_age=x[9], wants_region=x[10] is not None)
        own = lambda code: regions.where(F.col("region") == code).select("policy", "verdict", "reason") if code else None
        one = search.ranked(search.evaluate(policies, ask, own(x[6]), own(x[10])), search.default_order()).orderBy("rank").select(*keep).collect()
        assert [tuple(r) for r in one] == many.get(x[0], []), x
    counts = {r.question: r for r in questions.report(found, q, F.lit(True)).collect()}
    assert {k: r.matches for k, r in counts.items()} == {x[0]: len(many.get(x[0], [])) for x in rows}
    assert {k: r.first_id for k, r in counts.items() if r.matches} == {k: v[0][0] for k, v in many.items()}


def test_regions_of_pairs_are_as_of_one_region(spark, policies, tree):
    r = random.Random(2)
    rules = spark.createDataFrame([(r.randrange(240), r.choice(["include", "include", "exclude"]), r.choice(["world", "r1", "r2", "n1", "n2", "n9", "lost", None]), r.choice(["matched", "matched", "unmapped"]), r.choice(["active", "active", "retired"]), r.choice([None, "r1", "r2"])) for _ in range(600)], "policy long, relation string, code string, resolution string, region_status string, province string")
    base = policies.select(F.col("id").alias("policy"), "scope")
    asked = {"world": None, "r1": "r1", "n2": "r1", "n9": "r2"}
    pairs = base.select("policy", F.explode(F.array(*[F.struct(F.lit(c).alias("region"), F.lit(p).cast("string").alias("province")) for c, p in asked.items()])).alias("x")).select("policy", "x.region", "x.province")
    got = verdict.regions(pairs, base, rules, verdict.intervals(tree)).select("region", "policy", "verdict", "reason").collect()
    whole = verdict.closure(tree)
    want = [(c, *x) for c, p in asked.items() for x in verdict.region(base, rules, whole, c, province=p).collect()]
    assert sorted(map(tuple, got)) == sorted(want)


def test_intervals_of_deep_and_wide_trees(spark):
    r = random.Random(1)
    parents = {f"c{i}": (f"c{i - 1}" if i else None) for i in range(70)} | {f"w{i}": r.choice(["c0", "c5", "c69", None, "gone", f"w{i // 2}"]) if i else None for i in range(60)}
    nodes = spark.createDataFrame(list(parents.items()), "code string, parent string")
    up = lambda c: [] if parents.get(c) not in parents else [parents[c], *up(parents[c])]
    at = {x.code: x for x in verdict.intervals(nodes).collect()}
    assert {c: x.depth for c, x in at.items()} == {c: len(up(c)) for c in parents}
    for a in parents:
        for b in parents:
            assert (at[b].lo <= at[a].lo <= at[b].hi) == (b == a or b in up(a)), (a, b)
    with pytest.raises(ValueError, match="cycle"):
        verdict.intervals(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", None)], "code string, parent string"))
    assert verdict.intervals(nodes.limit(0)).count() == 0


def test_postings_read_their_buckets_and_take_changes(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    words = [f"w{i:03d}q" for i in range(300)]
    rows = spark.createDataFrame([(i * 1000, f"{words[i % 300]} all {'집' if i % 7 == 0 else ''}") for i in range(900)], "id long, t string")
    postings.add(rows, path, ["t"], 0)
    needles = spark.createDataFrame([("a", ["w017"]), ("b", ["집"]), ("c", ["17q", "all"]), ("d", ["W_17%Q"]), ("e", ["none"]), ("f", [])], "needle string, terms array<string>")
    brute = lambda table: {("a", i) for i, t in table if "w017" in t} | {("b", i) for i, t in table if "집" in t} | {("c", i) for i, t in table if "17q" in t and "all" in t} | {("d", i) for i, t in table if re.search("w.17.*q", t)} | {("f", i) for i, t in table}
    before = [tuple(r) for r in rows.collect()]
    assert {tuple(r) for r in postings.search(rows, path, needles, ["t"]).collect()} == brute(before)
    one = needles.where("needle = 'a'")
    wanted = postings.rarest(spark, path, one)
    every = set(spark.read.parquet(f"{path}/posts").inputFiles())
    got = postings.read(spark, path, wanted)
    assert len({f for (f,) in got.select(F.input_file_name()).distinct().collect()}) < len(every) / 10
    now = rows.where("id % 9000 <> 0").withColumn("t", F.when(F.col("id") % 4000 == 0, F.lit("w017 moved")).otherwise(F.col("t")))
    changed = now.where("id % 4000 = 0")
    for _ in range(2):  # a run that is done again writes the same
        postings.add(changed, path, ["t"], 1)
    assert {tuple(r) for r in postings.search(now, path, needles, ["t"]).collect()} == brute([tuple(r) for r in now.collect()])
    assert set(spark.read.parquet(f"{path}/posts").inputFiles()) > every


def test_scratch_tables_are_written_once(spark):
    from brightweir import policy_queries

    first = policy_queries.index(spark, "/root/testdata/sf0.001")
    assert policy_queries.index(spark, "/root/testdata/sf0.001") == first and first.startswith(session.shared_dir(spark))
