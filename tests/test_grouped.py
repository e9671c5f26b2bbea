"""Questions that meet kinds of policies find what they find among the policies one by one."""

from pyspark.sql import functions as F

from brightweir.operators import postings, questions, search


def test_groups_answer_as_policies_do_and_are_few(spark, tmp_path):
    rows = [(i, "Rent aid" if i % 3 else "bus aid", None, "", ["housing"] if i % 2 else [], ["n1"], 18 if i % 5 else None, None, "만  19세" if i % 4 else "제한  없음", "open", "valid", "regional") for i in range(200)]
    kinds = "id long, title string, summary string, support_content string, categories array<string>, regions array<string>, age_min int, age_max int, age_text string, status string, quality string, scope string"
    policies = questions.projected(search.search_document(spark.createDataFrame(rows, kinds))).cache()
    index = f"file://{tmp_path}/postings"
    postings.add(policies, index, questions.TEXTS, 0)
    asked = spark.createDataFrame([(i, ["rent"] if i % 2 else ["aid"], 17 + i % 3, "housing") for i in range(40)], "question long, terms array<string>, age int, category string")
    groups, members = questions.grouped(policies, asked, index)
    single = questions.answers(policies, asked, index)
    assert groups.count() * 10 < single.count()  # before, each question met every policy that it finds
    keep = ["question", "id", "rank", "score", "unknown_count", "age_verdict", "category_verdict"]
    of = lambda df: sorted(map(tuple, df.select(*keep).collect()), key=lambda r: (r[0], r[2]))
    assert of(questions.best_of(groups, members, 7)) == of(questions.best(single, 7))
    reports = [sorted(map(tuple, questions.report(x, asked, F.col("quality") == "valid").collect())) for x in (groups, single)]
    assert reports[0] == reports[1]
