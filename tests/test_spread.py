"""Tasks whose rows don't grow with the input."""

import random

from lattica.operators import algorithms, graph
from lattica.plans import lineage


def _graph(spark, seed=3, n=60, m=150):
    r = random.Random(seed)
    e = {(a, b) for a, b in ((r.randrange(n), r.randrange(n)) for _ in range(m)) if a < b}
    return sorted(e), spark.createDataFrame(sorted(e), "src long, dst long")


def test_co_occurrence_is_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(lineage, "SPREAD", 10)
    e, df = _graph(spark)
    met = graph.co_occurrence_counts(df)
    assert f", {-(-len(e) // 10)}), REPARTITION_BY_NUM" in met._jdf.queryExecution().executedPlan().toString()
    want = {}
    for p, m in e:
        for q, k in e:
            if m == k and p != q:
                want[p, q] = want.get((p, q), 0) + 1
    assert {(r.p, r.q): r.n for r in met.collect()} == want


def test_components_are_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(lineage, "SPREAD", 5)
    dealt = []
    monkeypatch.setattr(algorithms, "spread", lambda df, n, *keys: (dealt.append(n), lineage.spread(df, n, *keys))[1])
    e, df = _graph(spark, m=40)
    found = {r.id: r.component for r in algorithms.components(spark.range(60), df).collect()}
    assert dealt == [-(-len(e) // 5)]
    label = {v: v for v in range(60)}
    for _ in range(60):
        for a, b in e:
            label[a] = label[b] = min(label[a], label[b])
    assert found == label


def test_moves_shuffle_edges_once(spark, monkeypatch):
    _, df = _graph(spark)
    level = algorithms._Level(algorithms._weighted(df))
    plan = algorithms._move(level, level.ids.selectExpr("id", "id as community"), 0)._jdf.queryExecution().executedPlan().toString()
    level.close()
    assert plan.count("REPARTITION_BY_NUM") == 2  # the kept edges' own, and the one by nodes that may move
    members, scores = algorithms.louvain(df)
    assert abs(scores[-1] - algorithms.modularity(algorithms._weighted(df), members.select("id", "community"))) < 1e-9
    members, scores = algorithms.leiden(df)
    assert abs(scores[-1] - algorithms.modularity(algorithms._weighted(df), members.select("id", "community"))) < 1e-9 or len(scores) > 1
    least = {}
    for r in members.collect():
        least[r.community] = min(r.id, least.get(r.community, r.id))
    assert all(c == i for c, i in least.items())
