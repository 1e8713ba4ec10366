import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lattica.operators import algorithms, graph, retrieval, tabular, vector_index


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, "T", i) for i, (a, b) in enumerate(pairs)], "src long, dst long, type string, eid long")


def test_unique_and_composite_keys(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (None, "d")], "id int, name string")
    with pytest.raises(ValueError, match="occurs 2 times"):
        graph.assert_unique(df.select("id", "name").distinct(), "id")
    assert graph.assert_unique(df, "id", "name").count() == 4


def test_merge_is_idempotent_and_first_row_wins(spark):
    had = spark.createDataFrame([(1, "x")], "id int, label string")
    new = spark.createDataFrame([(2, "late", 5), (2, "first", 3), (1, "no", 1)], "id int, label string, ord int")
    once = graph.merge_nodes(had, new, ["id"], "ord")
    assert sorted(map(tuple, once.collect())) == [(1, "x"), (2, "first")]
    assert sorted(map(tuple, graph.merge_nodes(once, new, ["id"], "ord").collect())) == [(1, "x"), (2, "first")]
    e = edges(spark, [(1, 2), (1, 2), (2, 1), (1, 1)]).select("src", "type", "dst")
    assert graph.merge_edges(None, e).count() == 3 == graph.merge_edges(graph.merge_edges(None, e), e).count()


def test_last_write_skips_nulls(spark):
    rows = spark.createDataFrame([("d", 1, "a", None), ("d", 2, None, "x"), ("d", 3, "c", None)], "k string, ord int, u string, v string")
    assert tuple(graph.last_write(rows, ["k"], ["u", "v"], "ord").first()) == ("d", "c", "x")
    assert tuple(graph.first_write(rows, ["k"], ["u", "v"], "ord").first()) == ("d", "a", "x")


def test_undirected_counts(spark):
    assert sorted(map(tuple, graph.undirected(edges(spark, [(1, 2), (2, 1), (1, 1)])).select("src", "dst").collect())) == [(1, 1), (1, 2), (1, 2), (2, 1), (2, 1)]


def test_paths_don_t_repeat_edges(spark):
    start = spark.createDataFrame([(1,)], "id long")
    got = graph.paths(start, edges(spark, [(1, 2), (2, 3), (3, 1)]), 1, 5)
    assert sorted((r.finish, r.depth) for r in got.collect()) == [(1, 3), (2, 1), (3, 2)]


def test_reachable_on_a_cycle(spark):
    start = spark.createDataFrame([(1,)], "id long")
    got = algorithms.reachable(start, edges(spark, [(1, 2), (2, 3), (3, 1), (4, 1)]))
    assert sorted(map(tuple, got.collect())) == [(1, 0), (2, 1), (3, 2)]


def test_delete(spark):
    nodes = spark.createDataFrame([(1, ["A"]), (2, ["A"]), (3, ["B"])], "id long, labels array<string>")
    g = graph.PropertyGraph(nodes, edges(spark, [(1, 2), (2, 3)]))
    ids = spark.createDataFrame([(1,)], "id long")
    left = g.delete(ids)
    assert left.nodes.count() == 2 and left.edges.count() == 1
    with pytest.raises(ValueError):
        g.delete(ids, detach=False)
    assert g.with_label("A").count() == 2 and g.of_type("T").count() == 2 and g.of_type("X").count() == 0


def test_bad_triplets_are_set_aside(spark):
    rows = spark.createDataFrame([(["a", "works at", "b"],), (["a", "b"],), (["a", "b", "c", "d"],), (None,)], "triplet array<string>")
    g, bad = graph.triplets_to_graph(rows)
    assert [tuple(r) for r in g.edges.collect()] == [("a", "WORKS_AT", "b")] and g.nodes.count() == 2 and bad.count() == 3


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=14))
def test_components_like_union_find(spark, pairs):
    least = list(range(13))

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    for a, b in pairs:
        x, y = find(a), find(b)
        least[max(x, y)] = min(x, y)
    nodes = spark.range(13).select("id")
    got = algorithms.components(nodes, edges(spark, pairs))
    assert {r.id: r.component for r in got.collect()} == {i: find(i) for i in range(13)}


def test_largest_component_and_sizes(spark):
    members = algorithms.components(spark.range(6), edges(spark, [(0, 1), (2, 3)]))
    assert sorted(r.id for r in algorithms.largest_component(members).collect()) == [0, 1]
    assert algorithms.largest_component(members.limit(0)).count() == 0
    row = algorithms.size_distribution(members, "component").first()
    assert (row.groups, row.members, row.least, row.most) == (4, 6, 1, 2)


def test_louvain_finds_two_cliques(spark):
    clique = lambda base: [(base + i, base + j) for i in range(5) for j in range(i)]
    e = edges(spark, clique(0) + clique(10) + [(0, 10)]).select("src", "dst")
    found, scores = algorithms.louvain(e)
    groups = {}
    for r in found.collect():
        groups.setdefault(r.community, set()).add(r.id)
    assert sorted(map(sorted, groups.values())) == [[0, 1, 2, 3, 4], [10, 11, 12, 13, 14]]
    assert scores == sorted(scores) and scores[-1] > 0.4
    assert algorithms.refined(e, found).select("community").distinct().count() == 2


def test_top_k_ties_and_many_queries(spark, monkeypatch):
    items = spark.createDataFrame([(i, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(9)], "item_id long, vec array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vec array<double>")
    want = [(1, 1.0, 1), (3, 1.0, 2)]
    assert sorted((r.item_id, r.score, r["rank"]) for r in retrieval.top_k(queries, items, 2).collect()) == want
    monkeypatch.setattr(vector_index, "QUERIES", 1)
    assert sorted((r.item_id, r.score, r["rank"]) for r in retrieval.top_k(queries, items, 2).collect()) == want


def test_batches_pack_greedily(spark):
    rows = spark.createDataFrame([(i, 40) for i in range(10)] + [(10, 500)], "id long, tokens long")
    sums = retrieval.token_batches(rows, 100, "id").groupBy("batch").agg(F.sum("tokens").alias("n"), F.count("*").alias("k")).collect()
    assert sum(r.k for r in sums) == 11 and all(r.n <= 100 or r.k == 1 for r in sums)


def test_names_and_first_values(spark):
    df = tabular.strip_names(spark.createDataFrame([("a", None, 1), ("a", 5, 2), (None, 6, 3)], "` k ` string, v int, ord int"))
    assert [tuple(r) for r in tabular.first_by_group(df, "k", ["v"], F.col("ord")).collect()] == [("a", 5)]
    assert [tuple(r) for r in tabular.value_counts(df, "k").collect()] == [("a", 2)]
