"""Counts of pairs that are made where they are counted."""

import random
import re

from pyspark.sql import functions as F

from lattica.operators import graph
from lattica.plans import lineage


def _edges(spark, kind="long", m=400, p=40, seed=4):
    r = random.Random(seed)
    rows = [(r.randrange(p), r.choice((0, r.randrange(12)))) for _ in range(m)] + [(None, 3), (None, 3), (None, 0), (7, None), (7, None)]
    rows = rows if kind == "long" else [(None if a is None else f"n{a}", b) for a, b in rows]
    want = {}
    for i, (a, x) in enumerate(rows):
        for j, (b, y) in enumerate(rows):
            if i != j and x == y is not None and x is not None:
                want[a, b] = want.get((a, b), 0) + 1
    return want, spark.createDataFrame(rows, f"src {kind}, dst long")


def test_pairs_in_blocks_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(lineage, "SPREAD", 20)
    monkeypatch.setattr(graph, "CHUNK", 5)
    for kind in ("long", "string"):
        want, df = _edges(spark, kind)
        found = graph.co_occurrence_counts(df).collect()
        assert len(found) == len(want) and {(r.p, r.q): r.n for r in found} == want


def test_lists_travel_and_pairs_do_not(spark):
    # 60 nodes, each with edges from the same 50
    df = spark.range(3000).select((F.col("id") % 50).alias("src"), F.floor(F.col("id") / 50).alias("dst"))
    met = graph.co_occurrence_counts(df)
    assert {(r.p, r.q): r.n for r in met.collect()} == {(p, q): 60 for p in range(50) for q in range(50) if p != q}
    plan = met._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.index("Initial Plan")]
    # ends go by their node, once for both sides of the join, then lists to their blocks; counts were shuffled by p and q
    dealt = [re.search(r"\bExchange \w+\((?:\w+\()?(\w+)#", x)[1] for x in final.splitlines() if re.search(r"\bExchange ", x) and "ReusedExchange" not in x]
    assert dealt == ["block", "dst"] and "ReusedExchange" in final
