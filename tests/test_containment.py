"""Titles within titles meet as wholes, however many begin alike."""

from brightweir.operators import decide


def test_titles_that_begin_alike_are_not_compared_in_pairs(spark, capsys):
    names = [f"title{i:05d}" for i in range(3000)]
    short = spark.createDataFrame([(i, n) for i, n in enumerate(names)] + [(9000, "tiny"), (9001, None), (9002, "aaaaa")], "id long, key string")
    long = spark.createDataFrame([(i, f"x{n}y" if i % 2 else n) for i, n in enumerate(names)] + [(9000, "aaaaaaaaaa"), (9001, "a tiny one"), (9002, "")], "id long, key string")
    got = decide.contained_titles(short, long)
    assert sorted(map(tuple, got.collect())) == [(i, i) for i in range(1, 3000, 2)] + [(9002, 9000)]
    got.explain("formatted")
    plan = capsys.readouterr().out
    assert "contains(" not in plan.lower()  # before, all of one beginning met and were then compared


def test_no_side_of_a_duplicate_decision_is_sized_by_spark(spark, capsys):
    rows = spark.range(2000).selectExpr("id", "concat('title', lpad(id, 6, '0'), if(id % 3 = 0, 'longer', '')) AS title_key", "'org' AS org_key", "'help' AS support_key", "array('r1') AS region_keys", "DATE '1996-01-01' AS application_start", "DATE '1996-02-01' AS application_end", "if(id % 3 = 1, array(concat('http://x/', id)), array()) AS urls", "CAST(array() AS array<string>) AS announcements")
    mine = rows.selectExpr("id", "substring(title_key, 1, 11) AS title_key", "org_key", "support_key", "region_keys", "application_start", "application_end", "urls", "announcements", "if(id % 3 = 2, array(concat('b', id)), array()) AS references")
    base = rows.selectExpr("concat('b', id) AS id", "if(id % 3 = 0, title_key, concat('other', id)) AS title_key", *rows.columns[2:])
    got = decide.duplicate_decisions(mine, base)
    why = ["material_title_containment_requires_review", "canonical_url_match", "aggregator_external_id_match"]
    assert sorted((x.id, x.reason, x.matches) for x in got.collect()) == [(i, why[i % 3], 1) for i in range(2000)]
    got.explain("formatted")
    assert capsys.readouterr().out.split("== Initial Plan ==")[0].count("BroadcastHashJoin") <= 6  # those of beginnings with parts, a few rows; before, scans and all the counts too


def test_beginnings_that_are_many_are_no_broadcast(spark, capsys, monkeypatch):
    short, long = spark.createDataFrame([(1, "abcde"), (2, "bcdef")], "id long, key string"), spark.createDataFrame([(3, "xabcdef"), (4, "bcde")], "id long, key string")
    few = sorted(map(tuple, decide.contained_titles(short, long).collect()))
    monkeypatch.setattr(decide, "FEW", 0)
    got = decide.contained_titles(short, long)
    assert sorted(map(tuple, got.collect())) == few == [(1, 3), (2, 3)]
    got.explain("formatted")
    assert "BroadcastHashJoin" not in capsys.readouterr().out
