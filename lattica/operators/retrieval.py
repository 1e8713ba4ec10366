"""Retrieval: exact top-k by cosine, graph expansion of hits, budgets, and map-reduce over reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.graph import undirected
from lattica.operators.vector_index import VectorIndex
from lattica.plans.lineage import cut


def normalised(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vec): vectors of length one as array<double>; null and zero ones are left out."""
    v = F.transform(vector, lambda x: x.cast("double"))
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda t, x: t + x * x))
    return vectors.where(F.col(vector).isNotNull()).select(F.col(key), v.alias("vec"), n.alias("n")).where("n > 0").select(key, F.transform("vec", lambda x: x / F.col("n")).alias("vec"))


def top_k(queries: DataFrame, items: DataFrame, k: int = 5, **options) -> DataFrame:
    """(query_id, item_id, score, rank) of queries (query_id, vec) against items (item_id, vec) by cosine, exactly.

    Vectors are normalised. Scores are rounded to six digits and ties go to the smaller item_id. An index of the items
    is written first; to search one several times, or faster and not exactly, use `VectorIndex` itself.
    """
    return VectorIndex.build(items, **options).search(queries, k, exact=True)


def similar_pairs(vectors: DataFrame, least: float, same: str, forest: bool = False, **options) -> DataFrame:
    """(a, b, score) with a < b of vectors (id, vec of length one, and a column `same`) whose cosine is at least `least`.

    Only rows with equal `same`, null aside, are compared, and of those only the ones that their angles to the centres
    of a `VectorIndex` don't rule out. forest: only enough pairs (a, b) to connect what all of them connect.
    """
    return VectorIndex.build(vectors.select(F.col("id").alias("item_id"), "vec", F.col(same).alias("same")), **options).pairs(least, forest)


def merge_similar(vectors: DataFrame, least: float, same: str) -> DataFrame:
    """(id, representative): rows that similar pairs connect get the least id of their component."""
    from lattica.operators.algorithms import components

    pairs = similar_pairs(vectors, least, same, forest=True).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return components(vectors, pairs).withColumnRenamed("component", "representative")


def expand(hits: DataFrame, edges: DataFrame, types: Sequence[str], texts: DataFrame) -> DataFrame:
    """hits (query_id, item_id, score) with related: sorted texts (id, text) of neighbours over edges of some types, either way.

    Hits without neighbours go, as with an inner pattern.
    """
    both = undirected(edges.where(F.col("type").isin(*types)).select("src", "dst"))
    near = hits.join(both, hits["item_id"] == both["src"]).join(texts.select(F.col("id").alias("dst"), "text"), "dst")
    return near.groupBy("query_id", "item_id", "score").agg(F.array_sort(F.collect_list("text")).alias("related"))


def take_to_budget(rows: DataFrame, budget: int, by: Sequence[Column], tokens: str = "tokens", within: Sequence[str] = ()) -> DataFrame:
    """Rows in order while the sum of their tokens is within the budget, with running, that sum.

    Without groups, rows are dealt by ranges of the order; ranges' sums are added up first, and each range then adds its own.
    """
    inside = lambda *keys: Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if within:
        return rows.withColumn("running", F.sum(tokens).over(inside(*within))).where(F.col("running") <= budget)
    dealt = cut(rows.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()))
    sums = dealt.groupBy("_range").agg(F.sum(tokens).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    sums = sums.select("_range", F.coalesce(before, F.lit(0)).alias("_before")).where(F.col("_before") <= budget)
    running = F.col("_before") + F.sum(tokens).over(inside("_range"))
    return dealt.join(F.broadcast(sums), "_range").withColumn("running", running).where(F.col("running") <= budget).drop("_range", "_before")


#: Rows that a shard of `token_batches` aims at.
SHARD_ROWS = 100_000


def token_batches(rows: DataFrame, budget: int, key: str, tokens: str = "tokens", seed: int = 86, shards: int | None = None) -> DataFrame:
    """rows with shard and batch: shuffled by a seeded hash, then packed greedily until the next row would exceed the budget.

    Greedy packing is sequential, so each shard is packed by itself, in one pass over its sorted rows; there are as many
    shards as rows call for, or as are given.
    """
    shards = shards or max(1, -(-rows.count() // SHARD_ROWS))
    shard = F.pmod(F.xxhash64(key, F.lit(seed + 1)), F.lit(shards)).cast("int")
    shuffled = rows.withColumn("shard", shard).withColumn("_o", F.xxhash64(key, F.lit(seed))).repartition("shard").sortWithinPartitions("shard", "_o", key)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total, batch = None, 0, 0
        for b in batches:
            out = []
            for shard, n in zip(b.column("shard").to_pylist(), b.column(tokens).to_pylist()):
                n = n or 0
                if shard != at:
                    at, total, batch = shard, 0, 0
                elif total + n > budget and total > 0:
                    total, batch = 0, batch + 1
                total += n
                out.append(batch)
            kept = b.select([c for c in b.schema.names if c != "_o"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(out, pa.int32())], names=[*kept.schema.names, "batch"])

    fields = ", ".join(f"`{c}` {kind}" for c, kind in shuffled.dtypes if c != "_o")
    return shuffled.mapInArrow(pack, f"{fields}, batch int")


def global_search(reports: DataFrame, rate: Callable[[Column], Column], map_budget: int = 8000, reduce_budget: int = 8000, shards: int | None = None) -> DataFrame:
    """(id, pos, point, score, tokens, batch, running): the points that answer a question best, as far as a budget of tokens goes.

    Map: reports (id, text, tokens) are put into batches of at most map_budget tokens, and each batch says its points, the
    sentences of its reports with a rating above 0. Reduce: points of all batches in order of score, then id and place.
    """
    batched = token_batches(reports, map_budget, "id", shards=shards)
    batch = F.concat_ws("/", "shard", "batch").alias("batch")
    said = batched.select("id", batch, F.posexplode(F.split("text", r"(?<=[.?!])\s+")).alias("pos", "point"))
    points = said.withColumn("score", rate(F.col("point"))).where("score > 0").withColumn("tokens", F.size(F.filter(F.split("point", r"[ \t\n\x0B\f\r]+"), lambda w: w != "")).cast("long"))
    return take_to_budget(points, reduce_budget, [F.desc("score"), F.asc("id"), F.asc("pos")])


def reduced(points: DataFrame) -> DataFrame:
    """One row with the context of a reduced answer: the points that `global_search` took, best first, one a line.

    They are within its budget, so they fit into one row.
    """
    lines = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", "pos", "point"))), lambda x: x["point"])
    return points.agg(F.array_join(lines, "\n").alias("context"), F.count("*").alias("points"))


def local_search(entities: DataFrame, edges: DataFrame, mentions: DataFrame, hops: int = 1) -> DataFrame:
    """(chunk_id, hits): chunks that mention entities (id) or what lies within some hops of them, most mentions first."""
    from lattica.operators.graph import paths

    both = undirected(edges.select("src", "dst", "eid"))
    near = entities.select("id").union(paths(entities, both, 1, hops).select("finish")).distinct()
    return mentions.join(near, mentions["entity"] == near["id"]).groupBy("chunk_id").agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), "chunk_id")


def drift_search(entities: DataFrame, edges: DataFrame, mentions: DataFrame, community: DataFrame, reports: DataFrame, steps: int = 2, breadth: int = 10) -> DataFrame:
    """(step, kind, key, hits): what a search finds that drifts along the graph from entities (id).

    Each step counts the chunks that its frontier is mentioned in (mentions: chunk_id, entity) and the reports (community,
    report) of its communities (id, community). Then it follows edges either way: the `breadth` entities not yet visited
    that most edges of the frontier lead to, ties to the smaller id, are the next frontier. It ends after `steps`
    follow-ups, or when nothing new is reached.
    """
    both = undirected(edges.select("src", "dst"))
    frontier = cut(entities.select("id").distinct())
    visited, found = frontier, []
    for step in range(steps + 1):
        chunks = mentions.join(frontier, mentions["entity"] == frontier["id"], "left_semi").groupBy(F.col("chunk_id").cast("string").alias("key")).agg(F.count("*").alias("hits"))
        near = frontier.join(community, "id").groupBy("community").agg(F.count("*").alias("hits")).join(reports, "community")
        found += [chunks.select(F.lit(step).alias("step"), F.lit("chunk").alias("kind"), "key", "hits"), near.select(F.lit(step), F.lit("report"), F.col("report").cast("string"), "hits")]
        if step == steps:
            break
        reached = both.join(frontier, both["src"] == frontier["id"], "left_semi").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
        frontier = cut(reached.join(visited, "id", "left_anti").orderBy(F.desc("n"), "id").limit(breadth).select("id"))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return reduce(DataFrame.unionByName, [f.toDF("step", "kind", "key", "hits") for f in found])
