"""Graph algorithms as rounds of joins: components, reachability, Louvain communities and what is read off them."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators import communities
from lattica.operators.graph import induced
from lattica.plans.lineage import SPREAD, cut, partitions, spread
from lattica.session import ship

#: Edges that one task takes as a whole.
WHOLE = 3_000_000


def project(nodes: DataFrame, edges: DataFrame, label: str | None = None, types: tuple[str, ...] = ()) -> DataFrame:
    """(src, dst): the undirected projection of edges of some types between nodes of one label, without loops and repeats."""
    ids = (nodes.where(F.array_contains("labels", label)) if label else nodes).select("id")
    chosen = edges.where(F.col("type").isin(*types)) if types else edges
    return induced(ids, chosen).where("src <> dst")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): for each node (id) the least id that edges (src, dst), taken both ways, reach.

    Each round takes the least label of the neighbours and then that label's own label. Only whether a label changed
    goes to the driver.
    """
    links = cut(edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")))
    n = partitions(links)
    pairs = links.repartition(n, "src", "dst").distinct()
    both = spread(pairs.union(pairs.select("dst", "src")), n, "dst")
    labels = cut(both.groupBy(F.col("dst").alias("v")).agg(F.min("src").alias("m")).select("v", F.least("v", "m").alias("c")))
    while True:
        told = both.join(labels, F.col("dst") == F.col("v")).repartition(n, "src").groupBy("src").agg(F.min("c").alias("m"))
        lower = labels.join(told, F.col("v") == F.col("src")).select("v", "c", F.least("c", "m").alias("n"))
        target = labels.select(F.col("v").alias("t"), F.col("c").alias("tc"))
        after = cut(lower.repartition(n, "n").join(target, F.col("n") == F.col("t"), "left").select("v", "c", F.least("n", F.coalesce("tc", "n")).alias("n")))
        labels = after.select("v", F.col("n").alias("c"))
        if after.where("n <> c").isEmpty():
            break
    both.unpersist()
    return nodes.select("id").join(labels, F.col("id") == F.col("v"), "left").select("id", F.coalesce("c", "id").alias("component"))


def size_distribution(members: DataFrame, column: str) -> DataFrame:
    """One row: how many groups and members there are, and percentiles, least, most and mean of the groups' sizes."""
    sizes = members.groupBy(column).agg(F.count("*").alias("n"))
    percentile = lambda p: F.expr(f"percentile_disc({p}) within group (order by n)")
    return sizes.agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("members"), F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean"), percentile(0.5).alias("p50"), percentile(0.95).alias("p95"), percentile(0.999).alias("p999"))


def largest_component(members: DataFrame) -> DataFrame:
    """(id): members of the largest component, of equally large ones the one with the least id; none for an empty graph."""
    top = members.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return members.join(F.broadcast(top.select("component")), "component", "left_semi").select("id")  # one row


def reachable(start: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, depth): nodes that edges (src to dst) reach from start (id), itself included, and in how many steps; cycles are fine."""
    seen = cut(start.select("id").distinct().withColumn("depth", F.lit(0)))
    frontier, depth = seen, 0
    while not frontier.isEmpty():
        depth += 1
        step = frontier.join(edges, frontier["id"] == edges["src"]).select(F.col("dst").alias("id")).distinct()
        frontier = cut(step.join(seen, "id", "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(frontier)
    return seen


def in_category(category: DataFrame, narrower: DataFrame, membership: DataFrame) -> DataFrame:
    """(member, category): members attached to a category (id) or to any transitive subcategory of it.

    narrower: (src, dst), from a category to its subcategories; membership: (member, category).
    """
    below = reachable(category, narrower).select("id")
    return membership.join(below, membership["category"] == below["id"], "left_semi").select("member").distinct()


def modularity(edges: DataFrame, community: DataFrame, twice: float | None = None) -> float:
    """Modularity of (id, community) on undirected weighted edges (src, dst, weight); with twice what they add to that of a graph of this weight."""
    c = community.select(F.col("id").alias("v"), "community")
    e = edges.join(c.withColumnsRenamed({"v": "src", "community": "a"}), "src").join(c.withColumnsRenamed({"v": "dst", "community": "b"}), "dst")
    total = twice / 2 if twice else e.agg(F.sum("weight")).first()[0]
    if not total:
        return 0.0
    inside = e.where("a = b").agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]
    ends = e.select(F.col("a").alias("c"), "weight").union(e.select("b", "weight")).groupBy("c").agg(F.sum("weight").alias("d"))
    return inside / total - ends.agg(F.sum((F.col("d") / (2 * total)) ** 2)).first()[0]


def _move(level: _Level, community: DataFrame, turn: int) -> DataFrame:
    """One round of moves: nodes of one parity go to the neighbouring community that gains the most; ties go to the least.

    A community and its weight travel with its nodes to their neighbours, so edges are shuffled once, by the nodes that may move.
    """
    known = community.join(level.degree, "id")
    at = known.join(known.groupBy("community").agg(F.sum("k").alias("total")), "community")
    may = F.pmod(F.xxhash64("src", F.lit(turn)), F.lit(2)) == 0
    told = level.both.where(may).join(at.select(F.col("id").alias("dst"), F.col("community").alias("to"), "total"), "dst")
    near = told.repartition(level.n, "src").groupBy("src", "to").agg(F.sum("weight").alias("w"), F.first("total").alias("total"))
    choice = near.join(known.select(F.col("id").alias("src"), "k", F.col("community").alias("own")), "src")
    stay = F.col("to") == F.col("own")
    gain = F.round(F.col("w") - F.col("k") * (F.col("total") - F.when(stay, F.col("k")).otherwise(0)) / F.lit(level.twice), 9)
    choice = choice.select("src", "own", "to", gain.alias("gain"))
    best = choice.groupBy("src").agg(F.max_by(F.struct("to", "gain"), F.struct("gain", -F.col("to"))).alias("best"), F.max(F.when(stay, F.col("gain"))).alias("here"))
    rest = F.coalesce("here", F.lit(0.0))
    moved = best.where(F.col("best.gain") > rest).select(F.col("src").alias("id"), F.col("best.to").alias("to"))
    return community.join(moved, "id", "left").select("id", F.coalesce("to", "community").alias("community"), F.col("to").isNotNull().alias("moved"))


def _settled(level: _Level, community: DataFrame, rounds: int) -> DataFrame:
    """community after rounds of moves, until none of a second round's nodes gains by moving."""
    for turn in range(rounds):
        step = cut(_move(level, community, turn))
        community = step.select("id", "community")
        if turn % 2 and step.where("moved").isEmpty():
            break
    return community


def _refine(both: DataFrame, degree: DataFrame, twice: float, community: DataFrame, rounds: int) -> DataFrame:
    """(id, sub, community): communities taken apart into single nodes, which merge again inside their community only.

    A node that is still alone and well connected to its community (by at least what chance gives) joins the group there
    that gains the most, if that is well connected too. In a round half of the lone nodes may join, and only groups that
    none of these leaves, so a group is connected by the edges over which its nodes came; ties go to the least name. A
    lone node's group has its name.
    """
    n = both.rdd.getNumPartitions()
    c = community.select(F.col("id").alias("v"), F.col("community").alias("c"))
    ends = both.join(c.withColumnsRenamed({"v": "dst", "c": "b"}), "dst").repartition(n, "src").join(c.withColumnsRenamed({"v": "src", "c": "a"}), "src")
    # edges are there either way, so what is dealt by src is as well dealt by dst
    inside = ends.where("a = b").select(F.col("src").alias("dst"), F.col("dst").alias("src"), "weight").persist()
    within = community.join(degree, "id")
    within = within.join(within.groupBy("community").agg(F.sum("k").alias("all")), "community").join(inside.groupBy(F.col("dst").alias("id")).agg(F.sum("weight").alias("w")), "id", "left")
    chance = F.col("k") * (F.col("all") - F.col("k")) / F.lit(twice)
    state = cut(within.select("id", F.col("id").alias("sub"), "community", "k", "all", (F.coalesce("w", F.lit(0.0)) >= chance - 1e-9).alias("well")))
    for turn in range(rounds):
        told = inside.join(state.select(F.col("id").alias("dst"), F.col("sub").alias("to")), "dst").repartition(n, "src").groupBy("src", "to").agg(F.sum("weight").alias("w"))
        near = told.join(state.select(F.col("id").alias("src"), F.col("sub").alias("own")), "src").where("own <> to")
        leaving = near.groupBy(F.col("own").alias("sub")).agg(F.sum("w").alias("cut"))
        groups = state.groupBy("sub").agg(F.count("*").alias("n"), F.sum("k").alias("total"), F.first("all").alias("all"), F.first("well").alias("well")).join(leaving, "sub", "left")
        open_ = F.coalesce("cut", F.lit(0.0)) >= F.col("total") * (F.col("all") - F.col("total")) / F.lit(twice) - 1e-9
        moves = (F.col("n") == 1) & F.col("well") & (F.pmod(F.xxhash64("sub", F.lit(turn)), F.lit(2)) == 0)
        groups = cut(groups.select("sub", "total", moves.alias("moves"), open_.alias("open")))
        lone = near.where("src = own").join(groups.where("moves").select(F.col("sub").alias("src"), F.col("total").alias("k")), "src")
        met = lone.join(groups.where("not moves and open").select(F.col("sub").alias("to"), "total"), "to")
        gain = F.round(F.col("w") - F.col("k") * F.col("total") / F.lit(twice), 9)
        best = met.withColumn("gain", gain).where("gain > 0").groupBy(F.col("src").alias("id")).agg(F.max_by("to", F.struct("gain", -F.col("to"))).alias("to"))
        state = cut(state.join(best, "id", "left").withColumn("sub", F.coalesce("to", "sub")).withColumn("joined", F.col("to").isNotNull()).drop("to"))
        if turn % 2 and state.where("joined").isEmpty():
            break
        state = state.drop("joined")
    inside.unpersist()
    return state.select("id", "sub", "community")


class _Level:
    """A level's weighted edges, and what moves and refinements need of them."""

    def __init__(self, edges: DataFrame, twice: float | None = None):
        self.edges = edges
        self.ids = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
        loose = edges.where("src <> dst")
        self.n = partitions(edges)
        self.both = spread(loose.select("src", "dst", "weight").union(loose.select("dst", "src", "weight")), self.n, "dst")
        self.degree = cut(edges.select(F.col("src").alias("id"), "weight").union(edges.select("dst", "weight")).groupBy("id").agg(F.sum("weight").alias("k")))
        self.twice = twice or self.degree.agg(F.sum("k")).first()[0] or 1.0

    def modularity(self) -> float:
        """Modularity of the communities that the nodes stand for: what lies within one is its node's loop."""
        inside = self.edges.where("src = dst").agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]
        return 2 * inside / self.twice - (self.degree.agg(F.sum((F.col("k") / self.twice) ** 2)).first()[0] or 0.0)

    def close(self) -> None:
        self.both.unpersist()

    def contracted(self, named: DataFrame) -> DataFrame:
        """Edges between the groups of named (id, group)."""
        a, b = (named.select(F.col("id").alias(end), F.col("group").alias(c)) for end, c in (("src", "a"), ("dst", "b")))
        return cut(self.edges.join(a, "src").join(b, "dst").groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.sum("weight").alias("weight")))


def _weighted(edges: DataFrame, once: bool = False, expected: int | None = None) -> DataFrame:
    """Undirected edges (src, dst, weight), each once, with src <= dst, sorted; dealt by ranges of src, which leaves near ids together."""
    if "weight" not in edges.columns:
        edges = edges.withColumn("weight", F.lit(1.0))
    n = max(edges.sparkSession.sparkContext.defaultParallelism, -(-expected // (4 * SPREAD))) if expected else partitions(edges)
    ends = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight")
    weight = F.lit(1.0) if once else F.sum("weight").cast("double")
    return cut(ends.repartitionByRange(n, "src").groupBy("src", "dst").agg(weight.alias("weight")).sortWithinPartitions("src", "dst"))


def _in_tasks(rows: DataFrame, twice: float, levels: int, rounds: int, passes: int | None) -> tuple[DataFrame, list[float]]:
    """(id, levels) and scores of rows (bin, src, dst array, weight array, start), each bin in one task: see communities.whole."""
    ship(rows.sparkSession)
    work = lambda table: communities.whole(table, twice, levels, rounds, passes)
    found = cut(rows.groupBy("bin").applyInArrow(work, "id long, levels array<long>, scores array<double>"))
    scores = [r[0] for r in found.where("id is null").select("scores").collect()]
    return found.where("id is not null").select("id", "levels"), _added(scores)


def _added(scores: list[list[float]]) -> list[float]:
    """The sum of lists, of which the shorter ones go on with their last numbers."""
    return [math.fsum(s[min(i, len(s) - 1)] for s in scores if s) for i in range(max(map(len, scores), default=0))]


def _lists(edges: DataFrame) -> DataFrame:
    ship(edges.sparkSession)
    return edges.mapInArrow(communities.rows_of_sources, "src long, dst array<long>, weight array<double>").withColumn("start", F.lit(None).cast("long"))


def _dealt(first: DataFrame) -> tuple[DataFrame, int]:
    """(src, bin): bins of connected parts of the graph that a task takes as a whole, -1 for the larger parts; and how many bins.

    A part of more than WHOLE / 16 edges has its own bin, the others share some by their hash.
    """
    ship(first.sparkSession)
    stars = cut(first.select("src", "dst").mapInArrow(communities.forest, "src long, dst long"))
    labels = cut(components(stars.select(F.col("src").alias("id")).union(stars.select("dst")).distinct(), stars))
    at = cut(first.groupBy("src").agg(F.count("*").alias("n")).join(labels, F.col("src") == F.col("id"), "left").select("src", "n", F.coalesce("component", "src").alias("component")))
    sizes = cut(at.groupBy("component").agg(F.sum("n").alias("edges")))
    own = sizes.where((F.col("edges") > WHOLE // 16) & (F.col("edges") <= WHOLE))  # no more than 16 for each WHOLE edges
    small = sizes.where(F.col("edges") <= WHOLE // 16)
    owns, shared = own.count(), -(-4 * (small.agg(F.sum("edges")).first()[0] or 0) // WHOLE)
    bins = own.select("component", (F.row_number().over(Window.orderBy("component")) - 1).alias("bin"))
    bins = bins.union(small.select("component", (F.pmod(F.xxhash64("component"), F.lit(max(shared, 1))) + owns).cast("int")))
    bins = bins.union(sizes.where(F.col("edges") > WHOLE).select("component", F.lit(-1)))
    return cut(at.join(bins, "component").select("src", "bin")), owns + shared


def _communities(first: DataFrame, levels: int, rounds: int, passes: int | None) -> tuple[DataFrame, list[float]]:
    """(id, levels) and scores: Louvain's, or with passes Leiden's.

    Connected parts don't act on each other but by the weight of all edges, so parts that a task can hold are solved in
    one task each, and of the larger ones what is left when they have been contracted.
    """
    edges, total = first.agg(F.count("*"), F.sum("weight")).first()
    twice = 2 * total if total else 1.0
    if edges <= WHOLE:
        return _in_tasks(_lists(first).withColumn("bin", F.lit(0)), twice, levels, rounds, passes)
    dealt, bins = _dealt(first)
    found, scores = [], []
    if bins:
        rows = _lists(first).join(dealt.where("bin >= 0"), "src")
        solved, s = _in_tasks(rows.repartitionById(bins, "bin"), twice, levels, rounds, passes)
        found.append(solved)
        scores.append(s)
    large = dealt.where("bin < 0")
    if not large.isEmpty():
        e = cut(first.join(large.select("src"), "src"))
        solved, s = _louvain_rounds(e, twice, levels, rounds) if passes is None else _leiden_rounds(e, twice, levels, rounds, passes)
        found.append(solved)
        scores.append(s)
    members = reduce(DataFrame.union, found)
    # a part that is done earlier stays as it is on the others' further levels
    depth = members.agg(F.max(F.size("levels"))).first()[0]
    end = F.element_at("levels", -1 if passes is None else -2)
    more = F.array_repeat(end, F.lit(depth) - F.size("levels"))
    kept = F.concat("levels", more) if passes is None else F.concat(F.slice("levels", F.lit(1), F.size("levels") - 1), more, F.slice("levels", -1, 1))
    return members.select("id", kept.alias("levels")), _added(scores)


def louvain(edges: DataFrame, levels: int = 10, rounds: int = 12, once: bool = False, expected: int | None = None) -> tuple[DataFrame, list[float]]:
    """(id, levels array<long>, community) by Louvain on undirected edges (src, dst[, weight]), and each level's modularity.

    In a level nodes move for at most `rounds` rounds, half of them at a time (so neighbours don't swap for ever), then
    communities become the next level's nodes. A level that doesn't raise modularity ends it, or the last of `levels`:
    both bounds only end the search for better communities. Ids are whole numbers. With once repeats of an edge don't
    add up. expected: about how many edges there are; else they are counted.
    """
    members, scores = _communities(_weighted(edges, once, expected), levels, rounds, None)
    return members.select("id", "levels", F.element_at("levels", -1).alias("community")), scores


def _louvain_rounds(first: DataFrame, twice: float, levels: int, rounds: int) -> tuple[DataFrame, list[float]]:
    """(id, levels) and scores by rounds of joins, until a task can hold what is left."""
    level = _Level(first, twice)
    members = cut(level.ids.select("id", F.col("id").alias("community"), F.array().cast("array<bigint>").alias("levels")))
    scores: list[float] = []
    for depth in range(1, levels + 1):
        community = _settled(level, level.ids.withColumn("community", F.col("id")), rounds)
        named = community.select(F.col("id").alias("v"), F.col("community").alias("n"))
        after = members.join(named, F.col("community") == F.col("v"), "left").select("id", F.coalesce("n", "community").alias("community"), F.array_append("levels", F.coalesce("n", "community").cast("long")).alias("levels"))
        after = cut(after)
        contracted = level.contracted(community.withColumnRenamed("community", "group"))
        level.close()
        level = _Level(contracted, twice)
        score = level.modularity()
        if scores and score <= scores[-1] + 1e-9:
            break
        scores.append(score)
        members = after
        if depth < levels and contracted.count() <= WHOLE:
            rest, more = _in_tasks(_lists(contracted).withColumn("bin", F.lit(0)), twice, levels - depth, rounds, None)
            rest = rest.withColumnsRenamed({"id": "v", "levels": "more"})
            members = members.join(rest, F.col("community") == F.col("v")).select("id", F.concat("levels", "more").alias("levels"))
            scores += more
            break
    level.close()
    return members.select("id", "levels"), scores


def leiden(edges: DataFrame, levels: int = 10, rounds: int = 12, passes: int = 2, once: bool = False, expected: int | None = None) -> tuple[DataFrame, list[float]]:
    """(id, levels array<long>, community) by Leiden on undirected edges (src, dst[, weight]), and each pass's modularity.

    A level moves nodes as Louvain does, refines the communities (see `_refine`), and contracts the refined groups; the
    communities found so far are where the next level starts from. A pass ends when no groups merge any more, and the
    next one starts from its communities, until modularity stays or `passes` are done. levels has each level's refined
    groups, from fine to coarse, and the community last: every one is connected and lies within the next. Communities are
    named by their least ids, which are whole numbers. once and expected are as for `louvain`.
    """
    members, scores = _communities(_weighted(edges, once, expected), levels, rounds, passes)
    return members.select("id", "levels", F.element_at("levels", -1).alias("community")), scores


def _leiden_rounds(first: DataFrame, twice: float, levels: int, rounds: int, passes: int) -> tuple[DataFrame, list[float]]:
    """(id, levels) and scores by rounds of joins, until a task can hold what is left of a pass."""
    scores: list[float] = []
    best = start = None
    for _ in range(passes):
        level = _Level(first, twice)
        found, parts = start, None
        members = level.ids.select("id", F.col("id").alias("node"), F.array().cast("array<bigint>").alias("levels"))
        for depth in range(1, levels + 1):
            community = level.ids.withColumn("community", F.col("id")) if found is None else found
            refined_ = _refine(level.both, level.degree, level.twice, _settled(level, community, rounds), rounds)
            named = refined_.select(F.col("id").alias("node"), "sub", "community")
            members = cut(members.drop("community").join(named, "node").select("id", F.col("sub").alias("node"), F.array_append("levels", F.col("sub").cast("long")).alias("levels"), "community"))
            found = cut(refined_.select(F.col("sub").alias("id"), "community").distinct())
            if found.count() == refined_.count():
                break
            contracted = level.contracted(refined_.select("id", F.col("sub").alias("group")))
            level.close()
            level = _Level(contracted, twice)
            if depth < levels and contracted.count() <= WHOLE:
                none = lambda kind: F.array().cast(f"array<{kind}>")
                starts = found.select(F.col("id").alias("src"), none("bigint").alias("dst"), none("double").alias("weight"), F.col("community").alias("start"))
                rest = _in_tasks(_lists(contracted).union(starts).withColumn("bin", F.lit(0)), twice, levels - depth, rounds, 1)[0]
                parts = rest.select("id", F.element_at("levels", -1).alias("community"))
                more = rest.select(F.col("id").alias("node"), F.slice("levels", F.lit(1), F.size("levels") - 1).alias("more"))
                members = cut(members.join(more, "node").select("id", "node", F.concat("levels", "more").alias("levels"), "community"))
                break
        # a community that lost the nodes that held it together is as many communities as it has parts; groups are connected,
        # so their graph has the same parts
        parts = cut(refined(level.edges, found)) if parts is None else parts
        level.close()
        named = members.select("id", "node").join(parts.select(F.col("id").alias("node"), "community"), "node")
        least = named.groupBy("community").agg(F.min("id").alias("least"))
        whole = cut(named.join(least, "community").select("id", F.col("least").alias("community")))
        score = modularity(level.edges, parts, twice)
        if scores and score <= scores[-1] + 1e-9:
            break
        scores.append(score)
        start = whole
        best = cut(members.drop("community").join(whole, "id").select("id", F.array_append("levels", F.col("community").cast("long")).alias("levels")))
    return best, scores


def refined(edges: DataFrame, community: DataFrame) -> DataFrame:
    """(id, community): each community split into its connected parts, named by their least ids."""
    c = community.select(F.col("id").alias("v"), "community")
    inside = edges.join(c.withColumnsRenamed({"v": "src", "community": "a"}), "src").join(c.withColumnsRenamed({"v": "dst", "community": "b"}), "dst").where("a = b")
    return components(community, inside).select("id", F.col("component").alias("community"))


def hierarchy_levels(members: DataFrame) -> DataFrame:
    """(level, groups): how many different communities each level of (id, levels) has."""
    return members.select(F.posexplode("levels").alias("level", "c")).groupBy("level").agg(F.count_distinct("c").alias("groups"))


def hierarchy_counts(members: DataFrame, *path: str) -> DataFrame:
    """Members under each prefix of a path of columns, the root (all null) included."""
    return members.rollup(*path).agg(F.count("*").alias("members"))


def top_members(degrees: DataFrame, group: str, name: str, by: str, groups: int = 10, members: int = 20) -> DataFrame:
    """(group, members): the most connected members' names, joined by ', ', of the largest groups."""
    largest = degrees.groupBy(group).agg(F.count("*").alias("n")).orderBy(F.desc("n"), group).limit(groups)
    ranked = degrees.join(F.broadcast(largest), group)  # at most `groups` rows
    ranked = ranked.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(by), name))).where(F.col("_r") <= members)
    return ranked.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", name))), lambda x: x[name].cast("string")), ", ").alias("members"))
