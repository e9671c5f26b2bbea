"""Releases, verified scans, JSON schemas, element tables and the smaller operators of imports, by hand and by brute force."""

import gzip
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from brightweir.functions import parsing, schema, wording
from brightweir.operators import ingest, normalize, release
from brightweir.sources import tags, verified


def test_releases_are_blocked_verified_and_told_apart(spark, tmp_path):
    root = f"file://{tmp_path}/release"
    rows = spark.createDataFrame([(i, f"src{i % 2}", f"text {i}") for i in range(300)], "id long, source string, text string")
    checks = {"schema": {"id": "bigint", "source": "string", "text": "string"}, "allowed": {"source": ["src0", "src1"]}, "unsafe": {"mail": F.col("text").contains("@")}}
    top = release.install(rows, root, "v1", ["id"], **checks)
    assert release.verify(spark, root, ["id"]) == [] and len(top) == 64
    bad = {
        "unsafe:mail=1": rows.withColumn("text", F.when(F.col("id") == 7, "a@b").otherwise(F.col("text"))),
        "not_allowed:source=2": rows.withColumn("source", F.when(F.col("id") < 2, F.lit(None)).otherwise(F.col("source"))),
        "schema:more": rows.withColumn("more", F.lit(1)),
        "schema:id": rows.withColumn("id", F.col("id").cast("string")),
    }
    for fault, df in bad.items():
        with pytest.raises(ValueError, match=fault):
            release.install(df, root, "v2", ["id"], **checks)
    assert sorted(os.listdir(tmp_path / "release")) == ["pointer", "trees", "version=v1"] and release.active(spark, root).count() == 300
    assert release.install(rows.repartition(7), root, "v2", ["id"], **checks) == top  # the same content
    a, b = release.tree(rows, ["id"], 2), release.tree(rows.withColumn("text", F.when(F.col("id") == 9, "x").otherwise(F.col("text"))), ["id"], 2)
    part = hashlib.sha256(b'{"id":9}').hexdigest()[:2]
    assert [r.part for r in release.differing(a, b).collect()] == [part] and release.differing(a, a).count() == 0
    # Someone changes a file of the active version.
    rows.where("id <> 9").write.mode("overwrite").parquet(f"{root}/version=v2")
    found = release.verify(spark, root, ["id"])
    assert found and all(f.startswith("part:") for f in found)
    assert release.install(rows.limit(0), root, "v3", ["id"]) is not None and release.active(spark, root).count() == 0


def test_files_are_trusted_only_as_their_manifest_says(spark, tmp_path):
    at = tmp_path / "files"
    os.makedirs(at / "sub")
    content = {"a.csv": "code,v\n1,x\n2,y\n", "sub/b.csv.gz": "code,v\n3,z\n", "c.csv": "code,v\n9,q\n9,q\n", "d.csv.gz": "code,v\n5,d\n", "e.csv": "code,v\n,d\n", "f.csv": "code,v\n7,f\n", "g.csv": "code,v\n1,again\n"}
    for name, text in content.items():
        (at / name).write_bytes(gzip.compress(text.encode()) if name.endswith(".gz") else text.encode())
    told = [(n, hashlib.sha256(t.encode()).hexdigest(), len(t.encode()), t.count("\n") - 1, "s1") for n, t in content.items() if n != "f.csv"] + [("gone.csv", "0" * 64, 1, 1, "s1")]
    (at / "d.csv.gz").write_bytes(gzip.compress(b"other, and longer than before: 0123456789")[:-9])
    manifest = spark.createDataFrame(told, "path string, sha256 string, bytes long, rows long, scheme string")
    have = {r.path: r.sha256 for r in verified.digests(spark, f"file://{at}").collect()}
    assert set(have) == set(content) and have["d.csv.gz"] is None and have["a.csv"] == told[0][1]
    os.remove(at / "d.csv.gz")  # Spark's own reader stops at a broken file
    trusted, faults = verified.scanned(spark, f"file://{at}", manifest, "code long, v string", "code")
    assert {(r.path, r.fault) for r in faults.collect()} == {("a.csv", "key_repeated"), ("g.csv", "key_repeated"), ("c.csv", "key_repeated"), ("d.csv.gz", "missing"), ("gone.csv", "missing"), ("e.csv", "key_missing"), ("f.csv", "not_in_manifest")}
    assert [r.code for r in trusted.collect()] == [3]
    other = manifest.withColumn("scheme", F.when(F.col("path") == "a.csv", "s2").otherwise(F.col("scheme")))
    trusted, faults = verified.scanned(spark, f"file://{at}", other, "code long, v string", "code")
    assert trusted.count() == 0 and faults.where("fault = 'scheme_differs'").count() == len(told)


def test_schemas_say_where_and_what(spark):
    s = {"type": "object", "required": ["id"], "additionalProperties": False, "properties": {"id": {"type": "string", "pattern": "^[a-z]+$", "maxLength": 5}, "n": {"type": ["integer", "null"], "minimum": 0}, "tags": {"type": "array", "uniqueItems": True, "maxItems": 3, "items": {"enum": ["a", "b", 1]}}, "sub": {"$ref": "#/$defs/s"}, "k": {"const": {"x": 1}}}, "$defs": {"s": {"type": "object", "properties": {"l": {"type": "array", "minItems": 1, "items": {"type": "array", "items": {"type": "number"}}}}}}}
    cases = {
        '{"id":"abc","tags":["a",1]}': [],
        '{"id":"ABCDEF","n":-1,"tags":["a","a","c"],"z":1,"y":2}': ["$.y:additionalProperties", "$.z:additionalProperties", "$.id:pattern", "$.id:maxLength", "$.n:minimum", "$.tags:uniqueItems", "$.tags[2]:enum"],
        "[1]": ["$:type"],
        "null": ["$:type"],
        '{"tags":{},"n":1.5,"sub":{"l":[[1,"u"],3]}}': ["$.id:required", "$.n:type", "$.tags:type", "$.sub.l[0][1]:type", "$.sub.l[1]:type"],
        '{"id":"a","n":2.0,"sub":{"l":[]},"k":{"x":1}}': ["$.sub.l:minItems"],
        '{"id":"é","tags":["a","b",1,true]}': ["$.id:pattern", "$.tags:maxItems", "$.tags[3]:enum"],
        "{broken": None,
    }
    df = spark.createDataFrame([(c,) for c in cases], "j string")
    got = {r.j: r.f and [f"{x.path}:{x.code}" for x in r.f] for r in df.select("j", schema.faults(F.try_parse_json("j"), s).alias("f")).collect()}
    assert {k: v or [] for k, v in got.items()} == {k: v or [] for k, v in cases.items()} and got["{broken"] is None
    for bad in ({"oneOf": []}, {"items": {"format": "date"}}):
        with pytest.raises(ValueError, match="not understood"):
            schema.faults(F.lit(None), bad)
    with pytest.raises(ValueError, match="itself"):
        schema.faults(F.lit(None), {"$ref": "#/$defs/a", "$defs": {"a": {"$ref": "#/$defs/a"}}})


PAGES = {
    1: "<table><tr><td>a<td>b<table><tr><td>in</table>c<tr><th>K<td>v</table>tail",
    2: "<ul><li>one<ul><li>in<li>in 2</ul><li>two</ul><p>x<p>y<div>z</div></p>",
    3: "<h2>Who</h2><p>young <b>people</b><p> &amp; others<h2>How</h2><h2>When</h2><p>now<script><p>no</p></script>",
    4: "</td></table><a href='x?a=1&amp;b' href='no'>l<br>ink</a><td",
    5: "",
    6: None,
    7: "<div>" * 3000 + "deep",
}


def test_elements_of_broken_pages(spark):
    pages = spark.createDataFrame(list(PAGES.items()), "id long, html string")
    nodes = tags.elements(pages, "id", "html").cache()
    at = {}
    for r in nodes.collect():
        at.setdefault(r.id, {})[r.node] = r
    tag = lambda i, n: at[i][n].tag if n is not None else None
    cells = [(r.text, tag(1, r.parent)) for r in at[1].values() if r.tag in ("td", "th")]
    assert cells == [("a", "tr"), ("b in c", "tr"), ("in", "tr"), ("K", "tr"), ("v", "tr")]
    rows = [n for n, r in at[1].items() if r.tag == "tr"]
    assert len(rows) == 3 and [sum(r.parent == n for r in at[1].values()) for n in rows] == [2, 1, 2]
    assert [(r.text, tag(2, r.parent)) for r in at[2].values() if r.tag == "li"] == [("one in in 2", "ul"), ("in", "ul"), ("in 2", "ul"), ("two", "ul")]
    assert [(r.text, r.parent) for r in at[2].values() if r.tag == "p"] == [("x", None), ("y", None)]
    assert [(r.tag, r.attributes, r.text) for r in at[4].values()] == [("a", {"href": "x?a=1&b"}, "l ink"), ("br", {}, None)]
    assert 5 not in at and 6 not in at and len(at[7]) == 3000 and at[7][0].last == 2999
    assert {(r.label, r.value) for r in tags.labelled(nodes, "id").collect()} == {("K", "v")}
    got = {r.section: r.lines for r in tags.sections(nodes, "id", F.col("tag") == "h2", F.col("tag") == "p").where("id = 3").collect()}
    assert got == {"Who": ["young people", "& others"], "How": [], "When": ["now"]}
    inside = tags.inside(nodes, "id", F.col("tag") == "table", F.col("tag") == "td").where("id = 1").collect()
    tables = [n for n, r in at[1].items() if r.tag == "table"]
    assert sorted((r.text, tables.index(r.outer)) for r in inside) == [("a", 0), ("b in c", 0), ("in", 1), ("v", 0)]


def values(spark, f, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, c string")
    return [r.r for r in df.select("i", f(F.col("c")).alias("r")).orderBy("i").collect()]


def test_texts_cut_into_items_and_sentences(spark):
    texts = ["1. one\n2) two\nmore", "※ x ※ y", "<p>plain</p>", "• a\n- b", "a; b / c", "One. - two", None, "x\n\n\ny  z", "a - b", "2. only", "1.5 m\n2.5 m"]
    assert values(spark, wording.items, texts) == [["one", "two"], ["x", "y"], ["plain"], ["a", "b"], ["a", "b", "c"], ["One.", "two"], [], ["x", "y z"], ["a - b"], ["2. only"], ["1.5 m", "2.5 m"]]
    assert values(spark, lambda c: wording.sentence_with(c, "Rent"), ["First. Rent  help for 3. Last.", "none", None, "합니다 Rent 요 b", "No.Rent! x"]) == ["Rent help for 3.", None, None, "Rent 요", "No.Rent!"]
    assert values(spark, wording.list_title, [" Help  3 3일전", "new", "a NEW", "b 3일전 c"]) == ["Help 3", "new", "a", "b 3일전 c"]
    assert values(spark, wording.shown_text, ["\n\na \n\n\n b<br>\r\n", None]) == ["a\n\nb", ""]
    assert values(spark, lambda c: wording.section_key(c, {"Target": "who"}), ["○ Target (all)", "Target", "Target us", "-  Target  ( x ) "]) == ["who", "who", None, "who"]
    assert values(spark, wording.names_a_date, ["2024.5", "'24년 5월 3일", "2026.1.5", "2026년 상반기 중 1.5", "12024-1-2", "2024년 5월", None, "2026 . 1 . 5x"]) == [False, True, True, True, False, False, False, True]


def test_ranges_and_months(spark):
    day = lambda rs: rs and [(str(r.start), str(r.end)) for r in rs]
    got = values(spark, normalize.ranges, ["2026.1.1 ~ 2026.2.1 ~ 2026.3.1", "2026.1.1(월) ~ 2.3 | 2026-3-1 ~ 4/2", "2026.13.1~2027.1.1", "abc ~ 2026.2.1 ~ 2026.3.1", "2026.1.1, 2026.1.5 ~ 2.1", "2026.5.1 ~ 4.1", "2026.1.1 | x ~ 2.1", f"2026.1.1{'x' * 31}~2.1"])
    assert list(map(day, got)) == [[("2026-01-01", "2026-02-01")], [("2026-01-01", "2026-02-03"), ("2026-03-01", "2026-04-02")], [], [("2026-02-01", "2026-03-01")], [("2026-01-01", "2026-02-01")], [], [], []]
    got = values(spark, parsing.months, ["2025년 12월 ~ 2026년 2월", "2026.1~3", "2026.1.~3.", "2026년 13월 ~ 2월", "x 2026/1 ~ 2026/2 y", "no", None, "12026.1~3", "2025년 12 월~2026년 1월", "Ym 2026.1~3"])
    assert [(r.given, str(r.start), str(r.end)) for r in got] == [(True, "2025-12-01", "2026-02-28"), (True, "2026-01-01", "2026-03-31"), (True, "2026-01-01", "2026-03-31"), (True, "None", "2026-02-28"), (True, "2026-01-01", "2026-02-28"), (False, "None", "None"), (False, "None", "None"), (False, "None", "None"), (False, "None", "None"), (True, "2026-01-01", "2026-03-31")]


def test_manifests_are_written_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    a, b = ingest.write_once(df, f"file://{tmp_path}", "m"), ingest.write_once(df.repartition(3), f"file://{tmp_path}", "m")
    assert a == b and ingest.write_once(df.limit(1), f"file://{tmp_path}", "m") != a and len(os.listdir(tmp_path)) == 2


def test_documents_in_the_wrong_folder(spark, tmp_path):
    from brightweir.sources import raw

    os.makedirs(tmp_path / "store" / "source_id=a")
    (tmp_path / "store" / "source_id=a" / "x.json").write_text('{"document_id":"1","source_id":"a"}\n{"document_id":"2","source_id":"b"}\n{"document_id":"3"}\n')
    assert [tuple(r) for r in raw.misplaced(spark, f"file://{tmp_path}/store").collect()] == [("2", "b", "a")]


def test_cycles_of_one_and_of_several_parents(spark):
    from brightweir.operators import integrity

    found = lambda rows: sorted(r.code for r in integrity.cycles(spark.createDataFrame(rows, "code string, parent string")).collect())
    ring = [(f"r{i}", f"r{(i + 1) % 40}") for i in range(40)]
    assert found([*ring, ("tail", "r0"), ("r9b", "tail"), ("x", None)]) == sorted(f"r{i}" for i in range(40))
    two = [("a", "b"), ("b", "a"), ("b", "m"), ("m", "n"), ("n", "c"), ("c", "d"), ("d", "c"), ("self", "self")]
    assert found(two) == ["a", "b", "c", "d", "self"] and found([("a", "b")]) == []
