"""Near-duplicate vectors by product quantisation.

Unit vectors go to coarse inverted lists, as many as the square root of their number; what the list's centre leaves is
coded by subspaces. Centres and codewords are fitted on a bounded sample, all vectors are indexed and all are queries. A
vector probes every list whose border with its own list is within reach, so each list that can hold a vector within
reach. Candidates are found by table lookups: the distance to a coded vector differs from the true one by no more than
that vector's own coding error, which is known, so a candidate is kept if the looked-up distance is within reach plus that
error. Candidates are judged by their exact cosine. Neither step loses a link.

Equal vectors of one label are one class. Lists of a label share cells of a bounded number of vectors, and a large list has
several. Two vectors within reach probe each other's lists, so a pair of cells gets, of each, only the vectors that probe
the other, and compares them once for both. A task returns for each vector how much it links with, and one link for each
merger, not the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.chosen_path import Forest
from lattica.operators.algorithms import components
from lattica.llm.common import hash_sample
from lattica.plans.lineage import cut

COSINE = 0.93
#: Vectors that the index is fitted on, at most, and of them for each list, at least; subspaces and codewords.
SAMPLE, PER_LIST, SUBSPACES, CODEWORDS = 20_000, 20, 16, 64
#: Vectors of a cell, about (a cell of small lists has up to twice as many), and queries that are compared with it at a time.
CELL, QUERIES = 8192, 512
_ROUNDING = 1e-5


@dataclass
class Index:
    """centres: of the lists; words[s]: the codewords of subspace s; cuts: where subspaces begin and end; gaps: distances between centres."""

    centres: np.ndarray
    words: list[np.ndarray]
    cuts: np.ndarray
    gaps: np.ndarray


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    k = min(k, len(x))
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = (-2 * x @ centres.T + (centres**2).sum(1)).argmin(1)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=k)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


def fit(vectors: np.ndarray, n: int, subspaces: int = SUBSPACES, codewords: int = CODEWORDS) -> Index:
    """The index of n unit vectors, by a sample of them; it has about sqrt(n) lists, and no more than the sample can tell apart."""
    lists = max(1, min(math.isqrt(n), len(vectors) // PER_LIST))
    centres = k_means(vectors, lists)
    left = vectors - centres[nearest(vectors, centres)[0]]
    cuts = np.linspace(0, vectors.shape[1], min(subspaces, vectors.shape[1]) + 1).astype(int)
    return Index(centres, [k_means(left[:, a:z], codewords) for a, z in zip(cuts[:-1], cuts[1:])], cuts, np.sqrt(nearest(centres, centres)[1]))


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each vector, and all squared distances."""
    d = (x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)
    return d.argmin(1), np.maximum(d, 0)


def encode(index: Index, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of vectors in the lists `at`, and how far each coded vector is from the true one."""
    left = x - index.centres[at]
    codes = np.stack([(-2 * left[:, a:z] @ w.T + (w**2).sum(1)).argmin(1) for w, a, z in zip(index.words, index.cuts[:-1], index.cuts[1:])], 1)
    coded = np.concatenate([w[codes[:, s]] for s, w in enumerate(index.words)], 1)
    return codes.astype(np.uint8), np.sqrt(((left - coded) ** 2).sum(1))


def probes(index: Index, x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Which lists can hold a vector within reach of each query: those whose border with the query's own list is as near; and all squared distances."""
    own, d = nearest(x, index.centres)
    return d - d[np.arange(len(x)), own][:, None] <= 2 * (reach + _ROUNDING) * index.gaps[own] + _ROUNDING, d


def lookup_tables(index: Index, queries: np.ndarray) -> list[np.ndarray]:
    """For each subspace the products of queries with its codewords."""
    return [queries[:, a:z] @ w.T for w, a, z in zip(index.words, index.cuts[:-1], index.cuts[1:])]


def offsets(index: Index, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """What the distance to a coded vector has besides its query's distance to the list `at` and the looked-up products."""
    coded = np.concatenate([w[codes[:, s]] for s, w in enumerate(index.words)], 1)
    return (coded**2).sum(1) + 2 * (coded * index.centres[at]).sum(1)


def looked_up(tables: list[np.ndarray], to_list: np.ndarray, codes: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Distances from queries to coded vectors of one list; to_list: the queries' squared distances to its centre."""
    products = np.zeros((len(to_list), len(codes)))
    for s, table in enumerate(tables):
        products += table[:, codes[:, s]]
    return np.sqrt(np.maximum(0, to_list[:, None] + offset[None] - 2 * products))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.array(column.flatten(), np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # so that no square over- or underflows
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def near_vectors(rows: DataFrame, cosine: float = COSINE, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of rows (vec_id, embedding, label), one for each row.

    Vectors link if their labels are equal and not null and their cosine is at least `cosine`. A vector that is null,
    empty, zero, or has a null or non-finite component links with nothing; nor do vectors of unequal lengths link.
    n_links counts other rows, equal ones among them; component_id is the least vec_id that links reach, kept whether it
    is the row's own. A null vec_id counts as the largest and stays null. Other columns are not read.
    """
    spark = rows.sparkSession
    kind = rows.schema["vec_id"].dataType.simpleString()
    last = (1 << 63) - 1
    fine = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    all_rows = rows.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(last)).alias("v"), F.col("embedding").cast("array<double>").alias("e"), F.col("label"), F.coalesce(fine & F.col("label").isNotNull(), F.lit(False)).alias("fine"))
    # -0.0 is 0.0, for equal vectors to be equal
    real = "float" if rows.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    good = all_rows.where("fine").select("v", "label", F.transform("e", lambda x: (x + 0.0).cast(real)).alias("e"))
    good = good.withColumn("dim", F.size("e"))
    key = ["label", "dim", "e"]
    classes = cut(good.groupBy(*key).agg(F.min("v").alias("r"), F.count("*").alias("weight"), F.xxhash64("label", "e").alias("h")))
    indexes: dict[int, Index] = {}
    for dim, n in classes.groupBy("dim").count().collect():
        some = hash_sample(classes.where(F.col("dim") == dim).select("h", "e"), F.col("h"), sample, n).toArrow()
        indexes[dim] = fit(_unit(_matrix(some["e"], dim)), n)
    shared = spark.sparkContext.broadcast(indexes)
    reach = math.sqrt(2 - 2 * cosine)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector with its list and, by number, the lists it probes."""
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = b.filter(pa.array(dims == dim))
                for at in range(0, part.num_rows, 4096):
                    some = part.slice(at, 4096)
                    x = _unit(_matrix(some.column("e"), dim))
                    own = nearest(x, shared.value[dim].centres)[0]
                    may = probes(shared.value[dim], x, reach)[0]
                    probed = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * may.shape[1]), pa.array(may.ravel()))
                    yield pa.RecordBatch.from_arrays([*(some.column(c) for c in ("label", "dim", "e", "h", "weight")), pa.array(own.astype(np.int32)), probed], names=["label", "dim", "e", "h", "weight", "list", "probed"])

    label_type = rows.schema["label"].dataType.simpleString()
    placed = cut(classes.mapInArrow(place, f"label {label_type}, dim int, e array<{real}>, h long, weight long, list int, probed array<boolean>"))
    group = ["label", "dim"]
    sizes = placed.groupBy(*group, "list").agg(F.count("*").alias("n"))
    large = F.col("n") > CELL
    earlier = F.sum(F.when(large, 0).otherwise(F.col("n"))).over(Window.partitionBy(*group).orderBy("list")) - F.col("n")
    # of each list its first cell, and how many it has: a large one has cells of its own, small ones share one
    sizes = sizes.select(*group, "list", F.when(large, F.shiftleft((F.col("list") + 1).cast("long"), 32)).otherwise(F.floor(earlier / CELL)).alias("cell"), F.when(large, F.ceil(F.col("n") / CELL)).otherwise(1).cast("int").alias("cells"))
    lists = sizes.groupBy(*group).agg(F.collect_list(F.struct("list", "cell", "cells")).alias("lists"))
    placed = placed.join(lists, group)
    home = F.get(F.filter("lists", lambda x: x["list"] == F.col("list")), 0)
    placed = placed.withColumn("home", home).withColumn("home", F.col("home.cell") + F.pmod(F.xxhash64("h", F.lit(2)), F.col("home.cells").cast("long")))
    other = F.flatten(F.transform(F.filter("lists", lambda x: F.get("probed", x["list"])), lambda x: F.sequence(x["cell"], x["cell"] + x["cells"] - 1)))
    placed = placed.withColumn("other", F.explode(F.array_union(F.array("home"), other)))
    placed = placed.select(*group, "e", "h", "weight", "list", "home", F.least("home", "other").alias("i"), F.greatest("home", "other").alias("j"))

    def search(t: pa.Table) -> pa.Table:
        dim = t["dim"][0].as_py()
        index = shared.value[dim]
        lists, h, weight, home = (t[c].to_numpy() for c in ("list", "h", "weight", "home"))
        x = _unit(_matrix(t["e"], dim))
        first, second = t["i"][0].as_py(), t["j"][0].as_py()
        asks, mine = np.flatnonzero(home == first), np.flatnonzero(home == second)
        if not len(asks) or not len(mine):
            return pa.table({c: pa.array([], pa.int64()) for c in ("a", "b", "links")})
        codes, error = encode(index, x[mine], lists[mine])
        offset = offsets(index, codes, lists[mine])
        members = [(at, np.flatnonzero(lists[mine] == at)) for at in np.unique(lists[mine])]
        links, forest = np.zeros(len(h), np.int64), Forest(len(h))
        for low in range(0, len(asks), QUERIES):
            every = asks[low : low + QUERIES]
            may, d = probes(index, x[every], reach)
            tables = lookup_tables(index, x[every])
            for at, member in members:
                of = np.flatnonzero(may[:, at])
                some = every[of]
                a, b = np.nonzero(looked_up([t[of] for t in tables], d[of, at], codes[member], offset[member]) <= reach + error[None, member] + _ROUNDING)
                p, q = some[a], mine[member[b]]
                if first == second:
                    once = p < q
                    p, q = p[once], q[once]
                for cut_at in range(0, len(p), 200_000):
                    v, w = p[cut_at : cut_at + 200_000], q[cut_at : cut_at + 200_000]
                    near = np.einsum("ij,ij->i", x[v], x[w]) >= cosine
                    v, w = v[near], w[near]
                    links += np.bincount(v, weight[w], len(h)).astype(np.int64) + np.bincount(w, weight[v], len(h)).astype(np.int64)
                    forest.join(v, w)
        some = np.flatnonzero(links)
        return pa.table({"a": pa.array(h[some]), "b": pa.array(h[forest.least[some]]), "links": pa.array(links[some])})

    linked = cut(placed.groupBy(*group, "i", "j").applyInArrow(search, "a long, b long, links long"))
    reached = components(linked.select(F.col("a").alias("id")).distinct(), linked.select(F.col("a").alias("src"), F.col("b").alias("dst"))).select(F.col("id").alias("h"), F.col("component").alias("c"))
    reached = reached.join(classes.select("h", "r"), "h")
    reached = reached.join(reached.groupBy("c").agg(F.min("r").alias("component")), "c").select("h", "component")
    counts = linked.groupBy(F.col("a").alias("h")).agg(F.sum("links").alias("links"))
    found = classes.join(counts, "h", "left").join(reached, "h", "left")
    found = found.select(*key, (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "r").alias("c"))
    known = good.join(found, key).select("v", "n_links", "c")
    out = known.unionByName(all_rows.where("not fine").select("v", F.lit(0).cast("long").alias("n_links"), F.col("v").alias("c")))
    own_id = lambda c: F.when(F.col(c) != last, F.col(c)).cast(kind)
    return out.select(own_id("v").alias("vec_id"), "n_links", own_id("c").alias("component_id"), (F.col("v") == F.col("c")).alias("kept"))
