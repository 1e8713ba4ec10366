"""Declared keys, property names, and rows for each edge."""

import pytest
from pyspark.sql import functions as F

from lattica.operators import graph


def people(spark, rows):
    return spark.createDataFrame(rows, "name string, born int, id long")


def exchanges(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange hashpartitioning")


def test_merge_keeps_a_composite_key(spark):
    declared = graph.Catalogue().declare("Person", "name", "born")
    old = people(spark, [("a", 1, 10), ("a", 2, 11), (None, 1, 12), (None, 1, 13)])
    new = spark.createDataFrame([("a", 1, 90, 5, "x"), ("b", 1, 91, 7, "late"), ("b", 1, 92, 6, "first"), ("b", None, 93, 1, "y")], "name string, born int, id long, o int, more string")
    got = declared.merge("Person", old, new, "o")
    assert {tuple(r) for r in got.collect()} == {("a", 1, 10, None), ("a", 2, 11, None), (None, 1, 12, None), (None, 1, 13, None), ("b", 1, 92, "first"), ("b", None, 93, "y")}
    assert exchanges(got) == 1
    broken = old.union(people(spark, [("a", 2, 14)]))
    with pytest.raises(Exception, match=r"Person\(name, born\) is not unique.*\"a\".*2"):
        declared.merge("Person", broken, new, "o").collect()
    with pytest.raises(Exception, match=r"Person\(name, born\) has a null"):
        graph.Catalogue().declare("Person", "name", "born", required=True).merge("Person", old, new, "o").collect()


def test_writes_keep_every_key(spark, tmp_path):
    declared = graph.Catalogue().declare("Person", "name", "born").declare("Person", "id").declare("Other", "born")
    fine = people(spark, [("a", 1, 1), ("a", 2, 2), (None, 2, 3), (None, 2, 4), ("c", 1, None), ("d", 1, None)])
    declared.enforced("Person", fine).write.parquet(f"{tmp_path}/a")
    assert spark.read.parquet(f"{tmp_path}/a").count() == 6
    assert exchanges(graph.Constraint("Person", ("name",)).enforced(people(spark, [("a", 1, 1)]))) == 1
    with pytest.raises(Exception, match=r"Person\(id\) is not unique"):
        declared.enforced("Person", fine.union(people(spark, [("e", 1, 2)]))).write.parquet(f"{tmp_path}/b")
    # a second key holds for what a merge gives
    with pytest.raises(Exception, match=r"Person\(id\) is not unique"):
        declared.merge("Person", fine, spark.createDataFrame([("z", 9, 1, 1)], "name string, born int, id long, o int"), "o").collect()


def test_keys_of_nodes(spark):
    nodes = spark.createDataFrame([(1, ["A"], "n", None, {"k": "v", "none": None, "name": "again"}), (2, [], None, None, None), (3, ["B"], "m", 5, {})], "id int, labels array<string>, name string, size int, more map<string,string>")
    g = graph.PropertyGraph(nodes, spark.range(0))
    assert {r.id: r["keys"] for r in g.node_keys("more").collect()} == {1: ["k", "name"], 2: [], 3: ["name", "size"]}
    assert {r.id: r["keys"] for r in g.node_keys().collect()} == {1: ["more", "name"], 2: [], 3: ["more", "name", "size"]}


def test_a_row_for_each_edge(spark):
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    edges = spark.createDataFrame([(1, 2), (1, 2), (2, 1), (1, 1)], "src int, dst int")
    ids = lambda d: sorted(r.id for r in graph.connected(nodes, edges, d).collect())
    assert (ids("out"), ids("in"), ids("any")) == ([1, 1, 1, 2], [1, 1, 2, 2], [1, 1, 1, 1, 2, 2, 2])


def test_co_occurrences_are_counted_as_pairs_of_edges(spark):
    rows = [(1, 9, 0), (1, 9, 1), (2, 9, 2), (3, 8, 3), (1, 8, 4), (4, 7, 5)]
    edges = spark.createDataFrame(rows, "src int, dst int, eid int")
    want = {}
    for a in rows:
        for b in rows:
            if a[1] == b[1] and a[2] != b[2]:
                want[a[0], b[0]] = want.get((a[0], b[0]), 0) + 1
    assert {(r.p, r.q): r.n for r in graph.co_occurrence_counts(edges).collect()} == want
    assert {(r.p, r.q): r["count"] for r in graph.co_occurrence(edges, edges).groupBy("p", "q").count().collect()} == want
