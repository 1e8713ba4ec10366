"""Communities in one task against those by rounds of joins, and what either moves and stores."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import algorithms, communities
from lattica.plans import lineage


def _graph(spark, groups=4, size=14, islands=1, seed=5):
    """Groups of nodes with many edges inside and few between them, on some islands."""
    r = random.Random(seed)
    e = set()
    for i in range(islands):
        n = groups * size
        for _ in range(n * 4):
            a = r.randrange(n)
            b = r.randrange(n) if r.random() < 0.2 else a // size * size + r.randrange(size)
            if a != b:
                e.add((min(a, b) + 1000 * i, max(a, b) + 1000 * i))
    return sorted(e), spark.createDataFrame(sorted(e), "src long, dst long")


def _parts(nodes, pairs):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        root[max(top(a), top(b))] = min(top(a), top(b))
    return {n: top(n) for n in nodes}


def _sound(e, rows, scores, connected):
    """Levels are nested (and connected), communities are the last ones, and the last score is their modularity."""
    nodes = {n for p in e for n in p}
    assert set(rows) == nodes and len({len(v) for v in rows.values()}) == 1
    last = {n: v[-1] for n, v in rows.items()}
    inside, ends = sum(last[a] == last[b] for a, b in e), {}
    for p in e:
        for n in p:
            ends[last[n]] = ends.get(last[n], 0) + 1
    assert scores[-1] == pytest.approx(inside / len(e) - sum((d / 2 / len(e)) ** 2 for d in ends.values()))
    assert scores == sorted(scores)
    for k in range(len(next(iter(rows.values())))):
        group = {n: v[k] for n, v in rows.items()}
        if connected:
            assert len(set(_parts(nodes, [(a, b) for a, b in e if group[a] == group[b]]).values())) == len(set(group.values()))
        if k:
            assert len({(v[k - 1], v[k]) for v in rows.values()}) == len({v[k - 1] for v in rows.values()})


def test_hashes_are_sparks(spark):
    ids = [0, 1, -1, 5, 123456789, 2**40 + 3, -(2**62)]
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    for turn in (0, 1, 7, 11):
        want = [r[0] for r in df.select(F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(2)) == 0).collect()]
        assert communities.even(np.array(ids), turn).tolist() == want


def test_a_task_moves_as_rounds_of_joins_do(spark, monkeypatch):
    monkeypatch.setattr(communities, "STEP", 37)
    e, df = _graph(spark)
    level = algorithms._Level(algorithms._weighted(df))
    by_joins = algorithms._settled(level, level.ids.withColumn("community", F.col("id")), 3)
    refined = {r.id: r["sub"] for r in algorithms._refine(level.both, level.degree, level.twice, by_joins, 4).collect()}
    by_joins = {r.id: r.community for r in by_joins.collect()}
    level.close()
    ids = np.unique(np.array(e))
    a, b = np.searchsorted(ids, np.array(e)).T
    g = communities._Graph(a, b, np.ones(len(a)), np.arange(len(ids)), ids, communities.parts(len(ids), a, b), 2.0 * len(a))
    edges = g.both(np.ones(len(ids), bool))
    settled = g.settled(edges, g.names, 3)
    assert dict(zip(ids.tolist(), ids[settled].tolist(), strict=True)) == by_joins
    assert dict(zip(ids.tolist(), ids[g.refined(edges, settled, 4)].tolist(), strict=True)) == refined


@pytest.mark.parametrize("found", [algorithms.louvain, algorithms.leiden])
def test_parts_of_a_graph_are_solved_alike_in_any_tasks(spark, monkeypatch, found):
    e, df = _graph(spark, islands=3)
    members, scores = found(df)
    want = {r.id: [*r.levels] for r in members.collect()}
    _sound(e, want, scores, found is algorithms.leiden)
    monkeypatch.setattr(algorithms, "WHOLE", max(sum(1000 * i <= a < 1000 * (i + 1) for a, _ in e) for i in range(3)))
    monkeypatch.setattr(algorithms, "_Level", None)  # no part is larger than a task's, so nothing goes by rounds of joins
    members, apart = found(df)
    assert {r.id: [*r.levels] for r in members.collect()} == want and apart == pytest.approx(scores)


@pytest.mark.parametrize("found", [algorithms.louvain, algorithms.leiden])
def test_a_part_too_large_for_a_task_is_contracted_first(spark, monkeypatch, found):
    e, df = _graph(spark)
    pair = spark.createDataFrame([(5000, 5001)], "src long, dst long")  # and a small part beside it
    monkeypatch.setattr(algorithms, "WHOLE", len(e) - 1)
    members, scores = found(df.union(pair), rounds=4)
    _sound([*e, (5000, 5001)], {r.id: [*r.levels] for r in members.collect()}, scores, found is algorithms.leiden)
    assert scores[-1] > 0.4


def test_leiden_stores_a_few_tables_only(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(algorithms, "cut", lambda df: (stored.append(df), lineage.cut(df))[1])
    _, df = _graph(spark)
    algorithms.leiden(df)
    assert len(stored) == 2  # edges and communities; by rounds of joins each move and refinement was stored, over a hundred


def test_louvain_stores_edges_once(spark, monkeypatch):
    e, df = _graph(spark, islands=3)
    stored = []
    monkeypatch.setattr(algorithms, "cut", lambda df: (stored.append(t := lineage.cut(df)), t)[1])
    monkeypatch.setattr(algorithms, "spread", lambda df, n, *keys: (stored.append(df), lineage.spread(df, n, *keys))[1])
    monkeypatch.setattr(algorithms, "WHOLE", len(e) - 1)
    algorithms.louvain(df.union(df), once=True)
    assert sum(t.count() >= len(e) for t in stored) == 1  # every level kept its edges both ways, and the contracted ones


def test_repeats_count_once_if_so_asked(spark):
    e, df = _graph(spark)
    stored = algorithms._weighted(df.union(df.selectExpr("dst as src", "src as dst")), True, 2 * len(e))
    assert [tuple(r) for r in stored.orderBy("src", "dst").collect()] == [(a, b, 1.0) for a, b in e]
    assert {r.weight for r in algorithms._weighted(df.union(df)).collect()} == {2.0}


def test_forest_keeps_what_is_connected():
    import pyarrow as pa

    r = random.Random(2)
    e = [(r.randrange(300), r.randrange(300)) for _ in range(220)]
    batches = [pa.RecordBatch.from_arrays([pa.array([p[i] for p in e[s : s + 30]], pa.int64()) for i in (0, 1)], ["src", "dst"]) for s in range(0, 220, 30)]
    nodes = {n for p in e for n in p}
    for most in (50, 10_000):
        kept = [p for b in communities.forest(iter(batches), most) for p in zip(*(b.column(i).to_pylist() for i in (0, 1)), strict=True)]
        assert len(kept) < len(e) and _parts(nodes, kept) == _parts(nodes, e)
