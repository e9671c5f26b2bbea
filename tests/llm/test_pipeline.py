"""The corpus pipeline on a small fixture: what each stage drops and keeps."""

import itertools
import os

import pytest
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def near_copies_by_hand(texts):
    """The smallest id of each group of texts with five-word Jaccard similarity of 0.8 or more."""
    split = {i: (t or "").lower().split() for i, t in texts.items()}
    sets = {i: {tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))} if w else set() for i, w in split.items()}
    up = {i: i for i in texts}
    root = lambda x: x if up[x] == x else root(up[x])
    for a, b in itertools.combinations(sorted(texts), 2):
        if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return sorted({root(i) for i in texts})


def test_clashing_columns_and_an_empty_table(spark):
    import corpus_pipeline
    from brightweir import session

    docs = session.table(spark, DATA, "documents").where("doc_id < 40").withColumns({c: F.lit(7) for c in ("toxicity", "toxic_score", "n_words", "contaminated", "spans", "size", "root", "key", "row", "h")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns and 0 < out.count(), name
        assert stage(spark, docs.limit(0), DATA).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() == docs.count()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
def test_stages_against_their_operators(spark, tmp_path):
    import corpus_pipeline
    from brightweir import session
    from brightweir.llm import decontaminate

    docs = session.table(spark, DATA, "documents")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, seen[-1], DATA).write.parquet(f"{tmp_path}/{name}")
        seen.append(spark.read.parquet(f"{tmp_path}/{name}"))
    first, toxic, near, clean, mixed, tokens = seen
    assert all(x.columns == docs.columns for x in seen[:-1]) and 0 < toxic.count() <= first.count()
    assert sorted(r.doc_id for r in near.collect()) == near_copies_by_hand({r.doc_id: r.text for r in toxic.collect()})
    leaks = decontaminate.contamination(near, session.table(spark, DATA, "benchmark"))
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in leaks.where("NOT contaminated").collect())
    most = mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert most <= 3 and mixed.join(clean, "doc_id", "left_anti").count() == 0
    assert tokens.count() == mixed.count()
