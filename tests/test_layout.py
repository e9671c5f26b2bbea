"""The rest works without the corpus subpackage, which nothing else imports."""

import os
import re

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_nothing_else_imports_the_corpus_package():
    for d, _, names in os.walk(os.path.join(ROOT, "brightweir")):
        if os.path.relpath(d, ROOT).split(os.sep)[1:2] == ["llm"]:
            continue
        for n in names:
            if n.endswith(".py"):
                with open(os.path.join(d, n)) as f:
                    assert not re.search(r"brightweir\.llm|from brightweir import llm", f.read()), n


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__

    if os.path.isdir("/root/testdata/sf0.001"):
        assert __spark_entry__.entry(spark).columns == ["doc_id", "hits_text", "hits_source", "hits_lang", "score", "rank"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
