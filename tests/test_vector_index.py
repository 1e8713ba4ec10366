"""The stored vector index against all cosines, its recall on planted neighbours, and what it reads."""

import glob
import os

import numpy as np
import pytest
from lattica.operators import retrieval, vector_index
from lattica.operators.vector_index import VectorIndex
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def vectors():
    """Clusters with planted near neighbours, and one vector that a third of the rows copy."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 24))
    x = centres[rng.integers(0, 60, 1600)] + rng.normal(scale=0.3, size=(1600, 24))
    x = np.concatenate([x, x[:400] + rng.normal(scale=0.02, size=(400, 24)), np.repeat(x[:1], 1000, axis=0)])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def items(spark, vectors):
    return spark.createDataFrame([(i, v.tolist(), i % 3 if i % 50 else None) for i, v in enumerate(vectors)], "item_id long, vec array<double>, same int").cache()


def brute(x, rows, k):
    s = np.round(x[rows] @ x.T, 6)
    order = np.argsort(-s, axis=1, kind="stable")[:, :k]
    return {(int(q), int(i), float(s[n, i]), r + 1) for n, q in enumerate(rows) for r, i in enumerate(order[n])}


def queries(items, step=40):
    return items.where(F.col("item_id") % step == 0).select(F.col("item_id").alias("query_id"), "vec")


def found(df):
    return {(r["query_id"], r["item_id"], round(r["score"], 6), r["rank"]) for r in df.collect()}


def test_exact_search_misses_nothing(spark, items, vectors, monkeypatch):
    monkeypatch.setattr(vector_index, "PART", 100)
    monkeypatch.setattr(vector_index, "QUERIES", 10)  # a part's queries come in slices
    index = VectorIndex.build(items.drop("same"), lists=40)
    want = brute(vectors, list(range(0, len(vectors), 40)), 7)
    assert found(index.search(queries(items), 7, probes=2, exact=True)) == want
    assert max(r["n"] for r in index.parts.collect()) <= 200  # copies too
    assert index.items.count() == len(vectors)
    assert found(retrieval.top_k(queries(items), items.drop("same"), 7)) == want


def test_recall_of_planted_neighbours(spark, items, vectors):
    index = VectorIndex.build(items.drop("same"), lists=40)
    want = brute(vectors, list(range(0, len(vectors), 40)), 10)
    got = found(index.search(queries(items), 10, probes=6))
    assert len({(q, s) for q, _, s, _ in got} & {(q, s) for q, _, s, _ in want}) >= 0.95 * len({(q, s) for q, _, s, _ in want})
    planted = items.where("item_id >= 1600 and item_id < 2000").select(F.col("item_id").alias("query_id"), "vec")
    near = {(q, i) for q, i, _, _ in found(index.search(planted, 3, probes=2).where("query_id <> 1600"))}
    assert sum((q, q - 1600) in near for q in range(1601, 2000)) >= 0.95 * 399


def test_search_reads_probed_lists_only(spark, items, tmp_path):
    path = str(tmp_path / "index")
    VectorIndex.build(items, path, lists=40)
    index = VectorIndex.open(spark, path)
    one = items.where("item_id = 3").select(F.col("item_id").alias("query_id"), "vec")
    before = found(index.search(one, 5, probes=2))
    a = np.arccos(np.clip(index.centres @ np.array(one.first()["vec"]), -1, 1)).argsort()[:2]
    files = glob.glob(f"{path}/items/list=*/*.parquet")
    kept = [f for f in files if int(os.path.basename(os.path.dirname(f))[5:]) in a]
    assert 0 < len(kept) <= len(files) / 8
    for f in set(files) - set(kept):
        os.truncate(f, 4)  # reading any of these fails
        crc = os.path.join(os.path.dirname(f), f".{os.path.basename(f)}.crc")
        if os.path.exists(crc):
            os.remove(crc)
    assert len(before) == 5 and found(index.search(one, 5, probes=2)) == before


def test_pairs_of_equal_labels(spark, items, vectors, monkeypatch):
    monkeypatch.setattr(vector_index, "PART", 150)
    some = items.where("item_id < 2000")
    got = {(r["a"], r["b"], round(r["score"], 6)) for r in retrieval.similar_pairs(some.withColumnRenamed("item_id", "id"), 0.97, "same", lists=30).collect()}
    s = np.round(vectors[:2000] @ vectors[:2000].T, 6)
    label = [i % 3 if i % 50 else None for i in range(2000)]
    want = {(int(i), int(j), float(s[i, j])) for i, j in zip(*np.nonzero(np.triu(s >= 0.97, 1))) if label[i] is not None and label[i] == label[j]}
    assert got == want and len(want) > 50


def test_empty_and_small(spark, items):
    none = items.drop("same").limit(0)
    assert VectorIndex.build(none).search(queries(items), 3, exact=True).count() == 0
    index = VectorIndex.build(items.drop("same").where("item_id < 2"), lists=9)
    assert index.search(queries(items), 3, exact=True).count() == 2 * queries(items).count()
    assert index.search(queries(items).limit(0), 3).count() == 0
