"""A stored vector index: inverted lists around fitted centres, cut into rings by the vectors' angles to their centre.

The lists are folders of a Parquet table, so a search reads only the folders that it probes. By the triangle inequality a
query at an angle a to a centre can only meet vectors within an angle r of it in rings between a - r and a + r; that makes
searches exact where they are to be, without reading what can't be near.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.plans.lineage import cut, shared_path
from lattica.session import ship

#: Vectors that centres are fitted on at most; vectors that a list aims at, and lists at most, whose centres go to every task.
SAMPLE, LIST, LISTS = 20_000, 1024, 4096
#: Vectors that a part aims at (no part has twice as many), routed queries that meet a part at once, and cells of one product.
PART, QUERIES, CELLS = 10_000, 20_000, 4_000_000
#: Cells of a table of angles between vectors and centres, and components of the vectors of a block of `pairs`.
ANGLES, BLOCK = 500_000, 1_000_000
#: Bins of the angle to a centre, from which rings are made.
_BINS = 4096
#: What rounding may move an angle by.
_SLACK = 1e-5


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _angles(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ centres.T, -1, 1))


def _slices(batches: Iterator[pa.RecordBatch], lists: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that their table of angles to the centres is of bounded size."""
    step = max(1, ANGLES // max(1, lists))
    for b in batches:
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def _joined(name: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """name, a least place for each part of a graph, after edges between places p and q have joined parts."""
    while len(p):
        a, b = name[p], name[q]
        apart = a != b
        p, q, a, b = p[apart], q[apart], a[apart], b[apart]
        np.minimum.at(name, np.maximum(a, b), np.minimum(a, b))
        while (name != name[name]).any():
            name = name[name]
    return name


def _fitted(x: np.ndarray, lists: int, rounds: int = 6) -> np.ndarray:
    """At most `lists` different centres of length one, by spherical k-means over unit vectors; equal vectors count once."""
    x = np.unique(x, axis=0)
    centres = x[np.random.default_rng(1).permutation(len(x))[: max(1, min(lists, LISTS))]]
    for _ in range(rounds if len(centres) > 1 else 0):
        near = (x @ centres.T).argmax(axis=1)
        order = near.argsort(kind="stable")
        first = np.flatnonzero(np.diff(near[order], prepend=-1))
        sums = np.add.reduceat(x[order], first)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        fine = size[:, 0] > 1e-9
        centres[near[order][first][fine]] = sums[fine] / size[fine]
    return centres


@dataclass(frozen=True)
class VectorIndex:
    """centres: unit vectors by list; items: (item_id, vec, same, list, angle, ring, salt); parts: (list, same, ring, salt, low, high, n)."""

    centres: np.ndarray
    items: DataFrame
    parts: DataFrame

    @classmethod
    def build(cls, vectors: DataFrame, path: str | None = None, lists: int | None = None, sample: int = SAMPLE) -> VectorIndex:
        """Writes the index of vectors (item_id, vec of length one[, same]) to a new folder and opens it.

        Every row is indexed; centres are fitted on at most `sample` rows, chosen by a hash of item_id. Vectors must be
        of one length, others are an error. Without path the folder is in the cluster's shared one.
        """
        spark = ship(vectors.sparkSession)
        path = path or shared_path(spark, "index")
        v = vectors if "same" in vectors.columns else vectors.withColumn("same", F.lit(0))
        v = v.select("item_id", "vec", "same")
        n = v.count()
        share = F.shiftrightunsigned(F.xxhash64("item_id"), 32) < F.lit(int(min(1.0, 1.5 * sample / max(n, 1)) * 2**32))
        some = v.where(share).select("vec").limit(sample).toArrow().column("vec").combine_chunks()  # at most `sample` vectors
        centres = _fitted(np.stack(some.to_numpy(zero_copy_only=False)), lists or -(-n // LIST)) if n else np.zeros((0, 1))
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list int, centre array<double>").write.parquet(f"{path}/centres")

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _slices(batches, len(centres)):
                a = _angles(_matrix(b.column("vec"), centres.shape[1]), centres)
                nearest = a.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(nearest.astype(np.int32)), pa.array(a[np.arange(len(a)), nearest])], names=[*b.schema.names, "list", "angle"])

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in v.schema)
        near = cut(v.mapInArrow(assign, f"{kinds}, list int, angle double").withColumn("bin", F.floor(F.col("angle") * (_BINS / math.pi)).cast("int")))
        bins = near.groupBy("list", "same", "bin").agg(F.count("*").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("list", "same").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        # a bin of many vectors, such as copies of one, is a ring by itself and dealt by a hash
        bins = bins.select(F.col("list").alias("_l"), F.col("same").alias("_s"), F.col("bin").alias("_b"), F.floor(before / PART).cast("int").alias("ring"), F.ceil(F.col("n") / PART).cast("int").alias("salts"))
        dealt = near.join(bins, (near["list"] == bins["_l"]) & near["same"].eqNullSafe(bins["_s"]) & (near["bin"] == bins["_b"]))
        dealt = dealt.select("item_id", "vec", "same", "list", "angle", "ring", F.pmod(F.xxhash64("item_id", F.lit(7)), "salts").cast("int").alias("salt"))
        dealt.repartition("list", "same", "ring", "salt").write.partitionBy("list").parquet(f"{path}/items")
        items = spark.read.schema(dealt.schema).parquet(f"{path}/items")
        units = items.groupBy("list", "same", "ring", "salt").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count("*").alias("n"))
        units.write.parquet(f"{path}/parts")
        return cls(centres, items, spark.read.schema(units.schema).parquet(f"{path}/parts"))

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> VectorIndex:
        rows = ship(spark).read.parquet(f"{path}/centres").orderBy("list").collect()  # at most LISTS
        centres = np.array([r["centre"] for r in rows]) if rows else np.zeros((0, 1))
        return cls(centres, spark.read.parquet(f"{path}/items"), spark.read.parquet(f"{path}/parts"))

    @cached_property
    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """The least and the largest angle of a vector to its centre, by list; of an empty list such that nothing is near."""
        rows = self.parts.groupBy("list").agg(F.min("low"), F.max("high")).collect()  # at most LISTS
        low, high = np.full(len(self.centres), 9.0), np.full(len(self.centres), -9.0)
        for r in rows:
            low[r[0]], high[r[0]] = r[1:]
        return low, high

    def _routed(self, queries: DataFrame, most: int | None, beyond: int = 0) -> DataFrame:
        """queries (query_id, vec, same, reach) with list and angle: the `most` nearest lists, but not the `beyond` nearest, whose vectors may be within reach."""
        centres = self.centres
        low, high = self.bounds

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _slices(batches, len(centres)) if len(centres) else ():
                a = _angles(_matrix(b.column("vec"), centres.shape[1]), centres)
                reach = b.column("reach").to_numpy(zero_copy_only=False)[:, None] + _SLACK
                hit = (a - reach <= high) & (a + reach >= low)
                if beyond or most is not None:
                    place = a.argsort(axis=1, kind="stable").argsort(axis=1, kind="stable")
                    hit &= (place >= beyond) & (place < (len(centres) if most is None else most))
                row, cell = np.nonzero(hit)
                for at in range(0, len(row), 10_000):
                    r, c = row[at : at + 10_000], cell[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays([*b.take(pa.array(r)).columns, pa.array(c.astype(np.int32)), pa.array(a[r, c])], names=[*b.schema.names, "list", "angle"])

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema)
        return queries.mapInArrow(route, f"{kinds}, list int, angle double")

    def _met(self, routed: DataFrame, k: int | None, least: float, ordered: bool, match: bool) -> DataFrame:
        """(query_id, item_id, score): each part's best k for the queries that are routed to it, or all of at least `least`."""
        width = self.centres.shape[1]
        parts = self.parts.select(F.col("list").alias("_l"), F.col("same").alias("_s"), "ring", "salt", "low", "high")
        on = (F.col("list") == F.col("_l")) & (F.col("angle") - F.col("reach") - _SLACK <= F.col("high")) & (F.col("angle") + F.col("reach") + _SLACK >= F.col("low"))
        asked = routed.join(parts, on & F.col("same").eqNullSafe(F.col("_s")) & F.col("same").isNotNull() if match else on)
        asked = cut(asked.select("query_id", F.col("vec").alias("q"), "list", F.col("_s").alias("same"), "ring", "salt"))
        met = asked.groupBy("list", "same", "ring", "salt").agg(F.count("*").alias("n")).agg(F.max("n"), F.collect_set("list")).first()  # at most LISTS
        slices, probed = -(-(met[0] or 0) // QUERIES) or 1, met[1]
        items = self.items.where(F.col("list").isin(probed))
        unit = ["list", F.coalesce(F.xxhash64("same"), F.lit(0)).alias("_s"), "ring", "salt"]
        asked = asked.select("query_id", "q", *unit, F.pmod(F.xxhash64("query_id", F.lit(3)), F.lit(slices)).cast("int").alias("slice"))
        items = items.select("item_id", "vec", *unit, F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))

        def compare(left: pa.Table, right: pa.Table) -> pa.Table:
            right = right.sort_by("item_id")  # so that of equal scores the first has the least id
            x = _matrix(right.column("vec"), width)
            rows, cols, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
            step = max(1, CELLS // max(1, len(x)))
            for at in range(0, left.num_rows if len(x) else 0, step):
                s = np.round(_matrix(left.column("q").slice(at, step), width) @ x.T, 6)
                if k is None or k >= len(x):
                    row, col = np.nonzero(s >= least)
                else:
                    bound = np.partition(s, len(x) - k, axis=1)[:, len(x) - k][:, None]
                    sure, tied = s > bound, s == bound
                    tied &= np.cumsum(tied, axis=1) <= k - sure.sum(axis=1)[:, None]
                    row, col = np.nonzero(sure | tied)
                rows.append(row + at)
                cols.append(col)
                scores.append(s[row, col])
            found = pa.table({"query_id": left.column("query_id").take(pa.array(np.concatenate(rows))), "item_id": right.column("item_id").take(pa.array(np.concatenate(cols))), "score": np.concatenate(scores)})
            return found.filter(pa.compute.less(found.column("query_id"), found.column("item_id"))) if ordered else found

        keys = ["list", "_s", "ring", "salt", "slice"]
        kind = {f.name: f.dataType.simpleString() for df in (asked, items) for f in df.schema if f.name.endswith("_id")}
        return asked.groupBy(*keys).cogroup(items.groupBy(*keys)).applyInArrow(compare, f"query_id {kind['query_id']}, item_id {kind['item_id']}, score double")

    def search(self, queries: DataFrame, k: int = 5, probes: int = 8, exact: bool = False) -> DataFrame:
        """(query_id, item_id, score, rank): the k items of the highest cosine for each of queries (query_id, vec of length one).

        Only each query's `probes` nearest lists are read. exact then also reads what may hold something better than the
        k-th hit found so far, so that no hit is missed. Scores are exact, rounded to six digits; ties go to the smaller
        item_id.
        """
        q = queries.select("query_id", "vec", F.lit(0).alias("same"))
        order = [F.desc("score"), F.asc("item_id")]
        ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
        probes = len(self.centres) if exact and len(self.centres) <= 2 * probes else probes
        found = ranked(self._met(self._routed(q.withColumn("reach", F.lit(math.pi)), probes), k, -2.0, False, False))
        if exact and probes < len(self.centres):
            found = cut(found)
            last = found.where(F.col("rank") == k).select("query_id", F.acos(F.greatest(F.lit(-1.0), F.col("score") - 1e-6)).alias("reach"))
            q = q.join(last, "query_id", "left").withColumn("reach", F.coalesce("reach", F.lit(math.pi)))
            more = self._met(self._routed(q.select("query_id", "vec", "same", "reach"), None, probes), k, -2.0, False, False)
            found = ranked(found.drop("rank").unionByName(more))
        return found.select("query_id", "item_id", "score", "rank")

    def _blocks(self, least: float) -> tuple[DataFrame, DataFrame]:
        """Parts of one `same` put together to blocks, (list, same, ring, salt, block), and pairs of blocks, (same, a, b) with a <= b, that may hold a pair of rows."""
        centres, reach = self.centres, math.acos(max(-1.0, least - 1e-6)) + _SLACK
        rows = max(1, BLOCK // self.centres.shape[1])
        before = F.coalesce(F.sum("n").over(Window.partitionBy("same").orderBy("list", "ring", "salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        blocks = cut(self.parts.where("same is not null").withColumn("block", F.floor(before / rows).cast("int")))
        bounds = blocks.groupBy("same", "block").agg(F.collect_list(F.struct("list", "low", "high")).alias("p"))  # at most `rows` parts and one
        both = bounds.select("same", F.col("block").alias("a"), F.col("p").alias("x")).join(bounds.select("same", F.col("block").alias("b"), F.col("p").alias("y")), "same").where("a <= b")

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                    cx, cy = (centres[[p["list"] for p in z]] for z in (x, y))
                    hx, hy = (np.array([p["high"] for p in z]) for z in (x, y))
                    step = max(1, ANGLES // len(y))
                    # from one vector to another it is at least as far as between their centres, less the angles to these
                    keep.append(any((_angles(cx[at : at + step], cy) - hx[at : at + step, None] - hy <= reach).any() for at in range(0, len(x), step)))
                yield batch.select(["same", "a", "b"]).filter(pa.array(keep, pa.bool_()))

        kind = blocks.schema["same"].dataType.simpleString()
        return blocks.select("list", "same", "ring", "salt", "block"), cut(both.repartition("same", "a", "b").mapInArrow(near, f"same {kind}, a int, b int"))

    def pairs(self, least: float, forest: bool = False) -> DataFrame:
        """(a, b, score) with a < b of all items of equal `same`, null aside, whose rounded cosine is at least `least`.

        Blocks of a bounded number of vectors meet in pairs, those aside that their angles to the centres rule out, so a
        vector travels once for each block that it may meet. forest: of each pair of blocks only enough pairs to connect
        what all of them connect, (a, b), fewer than it has vectors.
        """
        width = self.centres.shape[1]
        blocks, met = self._blocks(least)
        b = blocks.withColumnsRenamed({"list": "_l", "same": "_s", "ring": "_r", "salt": "_t"})
        i = self.items
        items = i.join(b, (i["list"] == b["_l"]) & (i["same"] == b["_s"]) & (i["ring"] == b["_r"]) & (i["salt"] == b["_t"])).select("item_id", "vec", "same", "block")
        left = items.join(met.withColumnsRenamed({"a": "block", "b": "other"}), ["same", "block"]).select("item_id", "vec", "same", F.col("block").alias("a"), F.col("other").alias("b"))
        right = items.join(met.where("a < b").withColumnsRenamed({"b": "block", "a": "other"}), ["same", "block"]).select(F.col("item_id").alias("id"), F.col("vec").alias("v"), F.col("same").alias("s"), F.col("other").alias("p"), F.col("block").alias("q"))

        def compare(one: pa.Table, two: pa.Table) -> pa.Table:
            own = two.num_rows == 0  # a block with itself
            two = one if own else two.rename_columns([{"id": "item_id", "v": "vec"}.get(c, c) for c in two.column_names])
            x, y = _matrix(one.column("vec"), width), _matrix(two.column("vec"), width)
            rows, cols, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
            step = max(1, CELLS // max(1, len(y)))
            # names of the parts that the pairs so far connect: a row's place, or that of a row with which it is connected
            name = np.arange(len(x) + (0 if own else len(y)))
            for at in range(0, len(x), step):
                s = np.round(x[at : at + step] @ y.T, 6)
                row, col = np.nonzero(s >= least)
                if own:
                    row, col = row[row + at < col], col[row + at < col]
                score = s[row, col]
                row = row + at
                if forest:
                    name = _joined(name, row, col if own else col + len(x))
                else:
                    rows.append(row)
                    cols.append(col)
                    scores.append(score)
            ids = one.column("item_id").combine_chunks() if own else pa.chunked_array([*one.column("item_id").chunks, *two.column("item_id").chunks], one.schema.field("item_id").type).combine_chunks()
            if forest:
                row = np.flatnonzero(name != np.arange(len(name)))
                p, q, score = ids.take(pa.array(row)), ids.take(pa.array(name[row])), np.full(len(row), np.nan)
            else:
                row, col, score = map(np.concatenate, (rows, cols, scores))
                p, q = ids.take(pa.array(row)), ids.take(pa.array(col if own else col + len(x)))
            less = pa.compute.less(p, q)
            found = pa.table({"a": pa.compute.if_else(less, p, q), "b": pa.compute.if_else(less, q, p), "score": score})
            return found.filter(pa.compute.not_equal(found.column("a"), found.column("b")))  # rows may share an id

        kind = self.items.schema["item_id"].dataType.simpleString()
        found = left.groupBy("same", "a", "b").cogroup(right.groupBy("s", "p", "q")).applyInArrow(compare, f"a {kind}, b {kind}, score double")
        return found.select("a", "b") if forest else found
