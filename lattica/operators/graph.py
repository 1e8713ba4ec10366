"""A property graph as two DataFrames, and the upserts, updates and pattern matches over it.

nodes: id, labels array<string>, and property columns. edges: src, dst, type, and property columns; eid tells parallel
edges apart where a pattern needs that. Merges keep keys unique by construction; `assert_unique` checks them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.plans.lineage import cut, partitions


@dataclass(frozen=True)
class PropertyGraph:
    nodes: DataFrame
    edges: DataFrame

    def with_label(self, label: str) -> DataFrame:
        """Label scan."""
        return self.nodes.where(F.array_contains("labels", label))

    def of_type(self, *types: str) -> DataFrame:
        """Relationship-type scan; several types are alternatives, none is any type."""
        return self.edges.where(F.col("type").isin(*types)) if types else self.edges

    def schema_graph(self) -> DataFrame:
        """Distinct (src_label, type, dst_label) triples."""
        label = lambda side: self.nodes.select(F.col("id").alias(side), F.explode("labels").alias(f"{side}_label"))
        return self.edges.select("src", "dst", "type").join(label("src"), "src").join(label("dst"), "dst").select("src_label", "type", "dst_label").distinct()

    def property_keys(self) -> DataFrame:
        """(key): property columns that are set on some node."""
        names = [c for c in self.nodes.columns if c not in ("id", "labels")]
        counts = self.nodes.agg(*[F.count(c).alias(c) for c in names])
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).alias("n")) for c in names])).alias("p")
        return counts.select(pairs).where("p.n > 0").select("p.key")

    def node_keys(self, properties: str | None = None) -> DataFrame:
        """(id, keys): for each node the sorted names of the properties that are set on it.

        These are the property columns that aren't null, and the keys with values of a map column `properties`.
        """
        names = [c for c in self.nodes.columns if c not in ("id", "labels", properties)]
        keys = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in names])) if names else F.array().cast("array<string>")
        if properties:
            more = F.map_keys(F.map_filter(properties, lambda k, v: v.isNotNull()))
            keys = F.concat(keys, F.coalesce(more, F.array().cast("array<string>")))
        return self.nodes.select("id", F.array_sort(F.array_distinct(keys)).alias("keys"))

    def delete(self, ids: DataFrame, detach: bool = True) -> PropertyGraph:
        """Without the nodes in ids (id), and with detach without their edges; else edges that would dangle are an error."""
        gone = ids.select("id").distinct()
        touching = self.edges.join(gone, self.edges["src"] == gone["id"], "left_semi").unionByName(self.edges.join(gone, self.edges["dst"] == gone["id"], "left_semi"))
        if not detach and not touching.isEmpty():
            raise ValueError("nodes with relationships can't be deleted without detach")
        edges = self.edges.join(gone, self.edges["src"] == gone["id"], "left_anti")
        return PropertyGraph(self.nodes.join(gone, "id", "left_anti"), edges.join(gone, edges["dst"] == gone["id"], "left_anti"))


def assert_unique(df: DataFrame, *keys: str) -> DataFrame:
    """df, or a ValueError if two rows have equal keys (null keys aside)."""
    repeated = df.where(reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])).groupBy(*keys).count().where("count > 1")
    if (row := repeated.first()) is not None:
        raise ValueError(f"key {[row[k] for k in keys]} occurs {row['count']} times")
    return df


def merge_nodes(existing: DataFrame, new: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """existing with one row for each key of new that it lacks; of equal new keys the first in `order` sets the other columns."""
    others = [c for c in new.columns if c not in (*keys, order)]
    first = new.groupBy(*keys).agg(*[F.min_by(c, order).alias(c) for c in others]) if others else new.select(*keys).distinct()
    return existing.unionByName(first.join(existing, list(keys), "left_anti"), allowMissingColumns=True)


@dataclass(frozen=True)
class Constraint:
    """A key that is unique among the nodes of a label, if none of its properties is null; required: none may be null."""

    label: str
    keys: tuple[str, ...]
    required: bool = False

    def _checked(self, rows: DataFrame, single: Column) -> DataFrame:
        """rows, or an error that names the key where single doesn't hold, as part of the plan that uses them."""
        key = F.to_json(F.struct(*self.keys), {"ignoreNullFields": "false"})
        null = reduce(Column.__or__, [F.col(k).isNull() for k in self.keys])
        said = lambda what: F.raise_error(F.concat(F.lit(f"{self.label}({', '.join(self.keys)}) {what}: "), key)).cast("boolean")
        fine = F.when(null, said("has a null") if self.required else F.lit(True)).when(single, F.lit(True)).otherwise(said("is not unique"))
        return rows.where(fine)

    def enforced(self, rows: DataFrame) -> DataFrame:
        """rows, which fail to be computed if they break the constraint; one shuffle by the key, no second scan."""
        place = F.row_number().over(Window.partitionBy(*self.keys).orderBy(F.lit(1)))
        return self._checked(rows.withColumn("_place", place), F.col("_place") == 1).drop("_place")

    def merge(self, existing: DataFrame, new: DataFrame, order: str) -> DataFrame:
        """`merge_nodes` by the key, which fails if existing nodes share one; old and new rows meet in one shuffle.

        Nodes whose key has a null match nothing and stay, each by itself, unless the key is required.
        """
        null = reduce(Column.__or__, [F.col(k).isNull() for k in self.keys])
        both = existing.withColumns({"_new": F.lit(False), "_order": F.lit(None).cast(new.schema[order].dataType)}).unionByName(new.withColumnRenamed(order, "_order").withColumn("_new", F.lit(True)), allowMissingColumns=True)
        both = both.withColumn("_alone", F.when(null, F.monotonically_increasing_id()))
        others = [c for c in both.columns if c not in (*self.keys, "_new", "_order", "_alone")]
        first = [F.min_by(F.struct(*others), F.struct("_new", "_order")).alias("_first")] if others else []
        merged = both.groupBy(*self.keys, "_alone").agg(F.count_if(~F.col("_new")).alias("_old"), *first)
        return self._checked(merged, F.col("_old") <= 1).select(*[F.col(f"_first.{c}") if c in others else F.col(c) for c in both.columns if c not in ("_new", "_order", "_alone")])


@dataclass(frozen=True)
class Catalogue:
    """The constraints that are declared for a graph, and merges and writes that keep them."""

    constraints: tuple[Constraint, ...] = ()

    def declare(self, label: str, *keys: str, required: bool = False) -> Catalogue:
        return Catalogue((*self.constraints, Constraint(label, keys, required)))

    def of(self, label: str) -> list[Constraint]:
        return [c for c in self.constraints if c.label == label]

    def merge(self, label: str, existing: DataFrame, new: DataFrame, order: str) -> DataFrame:
        """Nodes of a label merged by its first declared key; its other keys hold for what comes out."""
        first, *others = self.of(label)
        return reduce(lambda df, c: c.enforced(df), others, first.merge(existing, new, order))

    def enforced(self, label: str, rows: DataFrame) -> DataFrame:
        return reduce(lambda df, c: c.enforced(df), self.of(label), rows)


def merge_with_actions(existing: DataFrame, new: DataFrame, key: str, on_create: dict[str, Column], on_match: dict[str, Column], always: dict[str, Column]) -> DataFrame:
    """Upsert by key: on_create columns for new keys, on_match ones for keys that were there, always for both; new is unique by key."""
    both = existing.withColumn("_had", F.lit(True)).join(new.select(key).distinct().withColumn("_came", F.lit(True)), key, "full_outer")
    had, came = F.col("_had").isNotNull(), F.col("_came").isNotNull()
    out = {}
    for c in dict.fromkeys([*existing.columns, *on_create, *on_match, *always]):
        if c == key:
            continue
        value = F.col(c) if c in existing.columns else F.lit(None)
        created, matched = on_create.get(c, always.get(c)), on_match.get(c, always.get(c))
        value = F.when(~had & came, created if created is not None else F.lit(None)).when(had & came, matched if matched is not None else value).otherwise(value)
        out[c] = value
    return both.select(key, *[v.alias(c) for c, v in out.items()])


def merge_edges(existing: DataFrame | None, new: DataFrame, keys: Sequence[str] = ("src", "type", "dst")) -> DataFrame:
    """One edge for each key; direction counts, loops are fine. More columns in keys make edges that differ in them parallel."""
    fresh = new.dropDuplicates(list(keys))
    return fresh if existing is None else existing.unionByName(fresh.join(existing, list(keys), "left_anti"), allowMissingColumns=True)


def last_write(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], order: str) -> DataFrame:
    """For each key and column the last value in `order` that isn't null."""
    return rows.groupBy(*keys).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def first_write(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], order: str) -> DataFrame:
    """For each key and column the first value in `order` that isn't null."""
    return rows.groupBy(*keys).agg(*[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def add_label(nodes: DataFrame, ids: DataFrame, label: str) -> DataFrame:
    """nodes with a label added to those whose id is in ids (id)."""
    marked = nodes.join(ids.select("id").distinct().withColumn("_in", F.lit(True)), "id", "left")
    return marked.withColumn("labels", F.when(F.col("_in"), F.array_union("labels", F.array(F.lit(label)))).otherwise(F.col("labels"))).drop("_in")


def set_property(nodes: DataFrame, column: str, value: Column, where: Column) -> DataFrame:
    return nodes.withColumn(column, F.when(where, value).otherwise(F.col(column) if column in nodes.columns else F.lit(None)))


def write_back(nodes: DataFrame, values: DataFrame, columns: Sequence[str]) -> DataFrame:
    """nodes with columns of values (id, ...) written onto those that have a row there; the others keep theirs, or null.

    Of several rows of an id the least value counts.
    """
    new = values.groupBy("id").agg(F.lit(True).alias("_in"), *[F.min(c).alias(f"_{c}") for c in columns])
    joined = nodes.join(new, "id", "left")
    for c in columns:
        joined = joined.withColumn(c, F.when(F.col("_in"), F.col(f"_{c}")).otherwise(F.col(c) if c in nodes.columns else F.lit(None)))
    return joined.drop("_in", *[f"_{c}" for c in columns])


def create_nodes(existing: DataFrame | None, new: DataFrame) -> DataFrame:
    """New nodes beside the existing ones, whether or not equal ones exist; columns that one side lacks are null there."""
    return new if existing is None else existing.unionByName(new, allowMissingColumns=True)


def connected(nodes: DataFrame, edges: DataFrame, direction: str = "any") -> DataFrame:
    """(n)-[]-(): a row of nodes for each edge that it has to whatever node: out, in, or any, where a loop counts once."""
    ends = {"out": edges.select(F.col("src").alias("id")), "in": edges.select(F.col("dst").alias("id")), "any": undirected(edges.select("src", "dst")).select(F.col("src").alias("id"))}
    return nodes.join(ends[direction], "id")


def pattern_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with n, how many edges (src) begin there; 0 where none do."""
    counts = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
    return nodes.join(counts, "id", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def is_empty(df: DataFrame) -> bool:
    """Whether nothing is loaded yet; at most one row is read."""
    return df.isEmpty()


def simple(edges: DataFrame) -> DataFrame:
    """(src, dst, n): the simple graph of a multigraph, without loops, with the number of edges between two nodes."""
    return edges.where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def remove_property(nodes: DataFrame, column: str, where: Column) -> DataFrame:
    return set_property(nodes, column, F.lit(None), where)


def undirected(edges: DataFrame) -> DataFrame:
    """Every edge in both directions; a loop once. Reciprocal edges give two rows each way, as a pattern without an arrow does."""
    return edges.unionByName(edges.where("src <> dst").withColumns({"src": F.col("dst"), "dst": F.col("src")}))


def hop(left: DataFrame, edges: DataFrame, right: DataFrame, optional: bool = False) -> DataFrame:
    """(a)-[r]->(b): left has id as a_id, right as b_id; with optional, left rows without an edge stay."""
    how = "left" if optional else "inner"
    return left.join(edges, left["a_id"] == edges["src"], how).join(right, edges["dst"] == right["b_id"], how)


def co_occurrence(first: DataFrame, second: DataFrame) -> DataFrame:
    """(p)-[e1]->(m)<-[e2]-(q) with e1 and e2 different edges: (p, m, q). Parallel edges of one node do meet."""
    a = first.select(F.col("src").alias("p"), F.col("dst").alias("m"), F.col("eid").alias("e1"))
    b = second.select(F.col("src").alias("q"), F.col("dst").alias("m"), F.col("eid").alias("e2"))
    return a.join(b, "m").where("e1 <> e2").select("p", "m", "q")


#: Nodes that one row of co_occurrence_counts carries at most to others' blocks.
CHUNK = 1000


def co_occurrence_counts(edges: DataFrame) -> DataFrame:
    """(p, q, n): how many pairs of different edges lead from p and from q to the same node, for all p and q.

    Parallel edges are counted first, and each pair of nodes is met once; the other way round has the same count. Ranges of
    nodes p, as many as edges call for, are blocks. To each block that it comes from a node sends the list of where its
    edges come from, and pairs are made and counted there, so no pairs are shuffled. Long lists go in chunks.
    """
    k = partitions(edges)
    n = edges.where("dst is not null").repartitionByRange(k, "src").groupBy("src", "dst").agg(F.count("*").alias("n"))
    # stored, since a range computed again may have other borders
    n = cut(n.withColumn("block", F.spark_partition_id()).sortWithinPartitions("src", "dst"))
    n = n.where("dst is not null and block is not null")  # what the join asks of one side is asked of both, so they share a shuffle
    place = F.row_number().over(Window.partitionBy("dst").orderBy("block", "src")) - 1
    ends = n.repartition(k, "dst").withColumn("chunk", (place / CHUNK).cast("int"))
    field = lambda c, name: F.transform(c, lambda x: x[name])
    own = ends.groupBy("dst", "block").agg(F.collect_list(F.struct("src", "n")).alias("a"))
    others = ends.groupBy("dst", "chunk").agg(F.collect_list(F.struct("src", "n", "block")).alias("b"), F.max("block").alias("last"))
    lists = own.join(others, "dst").where("last >= block").withColumn("b", F.expr("filter(b, x -> x.block >= block)"))
    lists = lists.select("block", field("a", "src").alias("ps"), field("a", "n").alias("n_ps"), field("b", "src").alias("qs"), field("b", "n").alias("n_qs"))
    each = lists.repartitionById(k, "block").select("block", F.posexplode("ps").alias("i", "p"), "n_ps", "qs", "n_qs")
    each = each.select("block", "p", F.expr("n_ps[i]").alias("n_p"), "n_qs", F.posexplode("qs").alias("j", "q")).withColumn("n_q", F.expr("n_qs[j]"))
    # nulls are in the first block; of the n * n pairs of one node's edges n are an edge with itself
    same = F.col("p").eqNullSafe(F.col("q"))
    met = each.where("p is null or p <= q").groupBy("block", "p", "q").agg(F.sum(F.col("n_p") * F.col("n_q") - F.when(same, F.col("n_p")).otherwise(0)).alias("n")).where("n > 0")
    both = F.when(same, F.array(F.struct("p", "q"))).otherwise(F.array(F.struct("p", "q"), F.struct(F.col("q").alias("p"), F.col("p").alias("q"))))
    return met.select(F.explode(both).alias("x"), "n").select("x.p", "x.q", "n")


def paths(start: DataFrame, edges: DataFrame, least: int = 1, most: int = 3) -> DataFrame:
    """(start, finish, depth, edges): one row for each trail of least to most edges from start (id); no edge twice in one."""
    e = edges.select("src", "dst", "eid")
    frontier = start.select(F.col("id").alias("start"), F.col("id").alias("finish"), F.array().cast("array<string>").alias("trail"))
    found = []
    for depth in range(1, most + 1):
        step = frontier.join(e, frontier["finish"] == e["src"]).where(~F.array_contains("trail", F.col("eid").cast("string")))
        frontier = step.select("start", F.col("dst").alias("finish"), F.array_append("trail", F.col("eid").cast("string")).alias("trail"))
        if depth >= least:
            found.append(frontier.select("start", "finish", F.lit(depth).alias("depth"), "trail"))
    return reduce(DataFrame.unionByName, found)


def induced(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends among members (id), as undirected ones without repeats: two hash joins, not a product of the set."""
    m = members.select("id").distinct()
    inside = edges.select("src", "dst").join(m.withColumnRenamed("id", "src"), "src", "left_semi").join(m.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return inside.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def prune(graph: PropertyGraph, labels: Sequence[str] | None = None, types: Sequence[str] | None = None) -> PropertyGraph:
    """Only nodes with one of the labels, edges of the types, and of those only the ones whose ends are both there."""
    nodes = graph.nodes if labels is None else graph.nodes.where(F.arrays_overlap("labels", F.array(*map(F.lit, labels))))
    edges = graph.edges if types is None else graph.edges.where(F.col("type").isin(*types))
    ids = nodes.select("id").distinct()
    edges = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return PropertyGraph(nodes, edges.select(*graph.edges.columns))


def resolve(graph: PropertyGraph, keys: Sequence[str]) -> PropertyGraph:
    """Nodes with equal keys become the one with the least id; edges are rewired to it and repeats go."""
    least = graph.nodes.where(reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])).groupBy(*keys).agg(F.min("id").alias("_to"))
    to = graph.nodes.select("id", *keys).join(least, list(keys)).select("id", "_to")
    nodes = graph.nodes.join(to, "id", "left").where(F.col("_to").isNull() | (F.col("_to") == F.col("id"))).drop("_to")
    edges = graph.edges
    for side in ("src", "dst"):
        edges = edges.join(to.select(F.col("id").alias(side), F.col("_to").alias("_new")), side, "left").withColumn(side, F.coalesce("_new", side)).drop("_new")
    return PropertyGraph(nodes, edges.select(*graph.edges.columns).dropDuplicates(["src", "type", "dst"]))


def triplets_to_graph(rows: DataFrame, triplet: str = "triplet") -> tuple[PropertyGraph, DataFrame]:
    """The graph of rows whose array column has [subject, relation, object], and the rows that don't have three parts.

    Entities merge by their exact names; a relation's type is its text in upper case with '_' for spaces.
    """
    fine = F.coalesce(F.size(triplet) == 3, F.lit(False))
    good = rows.where(fine).select(F.get(triplet, 0).alias("src"), F.upper(F.replace(F.get(triplet, 1), F.lit(" "), F.lit("_"))).alias("type"), F.get(triplet, 2).alias("dst"))
    nodes = good.select(F.col("src").alias("id")).union(good.select("dst")).distinct().select("id", F.array(F.lit("Entity")).alias("labels"), F.col("id").alias("name"))
    return PropertyGraph(nodes, merge_edges(None, good)), rows.where(~fine)


def merge_subgraphs(nodes: DataFrame, edges: DataFrame) -> PropertyGraph:
    """Nodes by (name, kind) with their descriptions joined, edges by (src, type, dst) with their frequency as weight."""
    merged = nodes.groupBy("name", "kind").agg(F.array_join(F.array_sort(F.collect_set("description")), " ").alias("description"))
    merged = merged.select(F.concat_ws(":", "kind", "name").alias("id"), F.array("kind").alias("labels"), "name", "description")
    return PropertyGraph(merged, edges.groupBy("src", "type", "dst").agg(F.count("*").alias("weight")))
