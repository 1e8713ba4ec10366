"""Work on vectors and texts in blocks of bounded size."""

import random

import numpy as np
import pytest

from lattica.functions import text
from lattica.operators import retrieval, vector_index
from lattica.operators.vector_index import VectorIndex


@pytest.fixture
def vectors(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(120, 8))
    x[100:] = x[:20] + r.normal(size=(20, 8)) / 50
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = [None if i % 13 == 0 else i % 2 for i in range(120)]
    return x, label, spark.createDataFrame([(i, x[i].tolist(), label[i]) for i in range(120)], "id long, vec array<double>, label int")


def _want(x, label, least):
    s = np.round(x @ x.T, 6)
    return {(i, j) for i in range(120) for j in range(i + 1, 120) if label[i] is not None and label[i] == label[j] and s[i, j] >= least}


def test_pairs_of_blocks_lose_none(vectors, monkeypatch):
    x, label, df = vectors
    monkeypatch.setattr(vector_index, "BLOCK", 8 * 10)
    index = VectorIndex.build(df.selectExpr("id as item_id", "vec", "label as same"), lists=9)
    for least in (0.35, 0.9):
        assert {(r.a, r.b) for r in index.pairs(least).collect()} == _want(x, label, least)
    blocks, met = index._blocks(0.35)
    n = {r.same: r["max(block)"] + 1 for r in blocks.groupBy("same").agg({"block": "max"}).collect()}
    assert all(k > 1 for k in n.values()) and met.count() <= sum(k * (k + 1) // 2 for k in n.values())  # not a copy of a vector for each list


def test_forest_connects_the_same(vectors, monkeypatch):
    x, label, df = vectors
    monkeypatch.setattr(vector_index, "BLOCK", 8 * 30)
    want = list(range(120))
    for _ in range(120):
        for i, j in _want(x, label, 0.35):
            want[i] = want[j] = min(want[i], want[j])
    assert {r.id: r.representative for r in retrieval.merge_similar(df, 0.35, "label").collect()} == dict(enumerate(want))
    few = retrieval.similar_pairs(df, 0.0, "label", forest=True).count()
    assert few < len(_want(x, label, 0.0)) / 4  # connections, not all pairs


def test_tables_of_angles_are_bounded(vectors, monkeypatch):
    monkeypatch.setattr(vector_index, "ANGLES", 50)
    _, _, df = vectors
    batch = df.select("id").toArrow().to_batches()[0]
    assert [b.num_rows for b in vector_index._slices([batch], 10)][:2] == [5, 5]


def test_headlines_leave_a_few_texts_at_a_time(spark, monkeypatch):
    r = random.Random(2)
    rows = [(i, None if i == 3 else "\n".join(r.choice(["# Head", "some words here, and more.", "", "x y z " * 60]) for _ in range(r.randrange(9)))) for i in range(40)]
    monkeypatch.setattr(text, "TEXTS", 7)
    found = text.chunk_by_headlines(spark.createDataFrame(rows, "doc_id long, text string"), 20, 50)
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    want = {(i, j): p for i, t in rows for j, p in enumerate(text.pack_sections(t, 20, 50))}
    assert {(x.doc_id, x.chunk_id): (x.headline, x.chunk, x.tokens) for x in found.collect()} == want


def test_keyphrases_join_a_table_of_known_size(spark, monkeypatch):
    kept, cut = [], text.cut
    monkeypatch.setattr(text, "cut", lambda df: (kept.append(df.columns), cut(df))[1])
    docs = spark.createDataFrame([(1, "alpha alpha beta"), (2, "beta gamma"), (3, None)], "doc_id long, text string")
    assert [(r.doc_id, r.rank, r.term) for r in text.keyphrases(docs, 1).orderBy("doc_id").collect()] == [(1, 1, "alpha"), (2, 1, "gamma")]
    assert kept == [["doc_id", "term", "tf"], ["term", "df"]]
