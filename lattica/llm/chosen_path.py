"""N-gram Jaccard join by chosen paths.

Rows with equal shingle sets are one class; only one representative of each goes on. Each set is embedded as COORDINATES
MinHash values. A run starts with the value of one sampled coordinate, so sets meet in a bucket if they share that token.
Buckets of one are done with. Buckets of up to SMALL sets are compared by brute force over the embedding. Larger ones are
split again on SPLITS more sampled tokens each, as long as that leaves fewer rows than the bucket has, so no depth has
more rows than the one before; a bucket whose sets are more alike than that, or DEPTH deep, is one group of candidates.
Each depth is written before the next one reads it. With RUNS repeats a pair of likeness 0.8 in small buckets is missed
with a probability of 0.2 ** RUNS, and one that only meets in large buckets with one of about 0.00001.

Candidates that hang together form a group, and within a group every pair of sets is compared exactly, in blocks of a
bounded number of sets and of shingles. So each link is found once, whatever buckets it met in, and no list of pairs is
written anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import Words, chunks, mix64, row_key, span_hashes
from lattica.operators.algorithms import components
from lattica.plans.lineage import cut

WORDS, NUMERATOR, DENOMINATOR = 5, 4, 5  # likeness of 4 / 5 or more
COORDINATES, RUNS, SPLITS, DEPTH = 48, 12, 2, 12
#: Members of a bucket up to which all its pairs are compared, and embedded values that a candidate pair shares there.
SMALL, SHARED = 4096, 25
#: Members up to which the buckets of a batch are compared all at once.
TINY = 32
#: Bits of the filter of texts that are compared exactly; it has this size however many there are.
FILTER = 1 << 26
#: Sets and shingles of a block in exact comparison, and sets and shingles that a matrix of them holds at a time.
BLOCK_SETS, BLOCK_SHINGLES = 4096, 1_000_000
ROWS, COLUMNS = 512, 4096
_SEEDS = mix64(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def shingles(words: Words, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of some texts, in that order; a text of fewer than n words is one shingle."""
    h, first = words.hashes(), words.first
    size = np.diff(first)
    count = np.where(size >= n, size - n + 1, np.minimum(size, 1))
    text = np.repeat(np.arange(len(size)), count)
    at = first[text] + np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    s = span_hashes(h, at, np.minimum(at + n, first[1:][text]))
    order = np.lexsort((s, text))
    text, s = text[order], s[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (text[1:] != text[:-1])
    return text[new], s[new]


def class_keys(s: np.ndarray, begin: np.ndarray, full: np.ndarray, n: int) -> np.ndarray:
    """Two 64-bit hashes of each of n texts' shingle sets; 0 for the texts that aren't in `full`."""
    keys = np.zeros((2, n), np.uint64)
    if len(full):
        for k in range(2):
            keys[k, full] = np.add.reduceat(mix64(s ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1)), begin)
    return keys


def embeddings(docs: DataFrame) -> DataFrame:
    """(d, x, y, size, m): for each text two hashes of its shingle set, its size and its MinHash values; texts without words have null hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, w in chunks(b):
                text, s = shingles(w)
                full, begin = np.unique(text, return_index=True)
                keys = class_keys(s, begin, full, j - i)
                values = np.zeros((j - i, COORDINATES), np.int32)
                if len(full):
                    for k in range(COORDINATES):
                        # of an odd multiple the top half is as good a hash as any: s is mixed already
                        values[full, k] = (np.minimum.reduceat(s * _SEEDS[k] ^ _SEEDS[-1 - k], begin) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                none = np.ones(j - i, bool)
                none[full] = False
                lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * COORDINATES), pa.array(values.ravel()))
                size = np.bincount(text, minlength=j - i)
                yield pa.RecordBatch.from_arrays([b.column("d").slice(i, j - i), pa.array(keys[0].view(np.int64), mask=none), pa.array(keys[1].view(np.int64), mask=none), pa.array(size), lists], names=["d", "x", "y", "size", "m"])

    return docs.select("d", "text").mapInArrow(run, f"d {docs.schema['d'].dataType.simpleString()}, x long, y long, size long, m array<int>")


def _split(node: Column, coordinate: Column) -> Column:
    return F.xxhash64(node, coordinate, F.get("m", coordinate))


def _small_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of the members of buckets (node, r, m), in order of node, that share enough embedded values, as a forest."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        node = t["node"].to_numpy()
        whole = int(np.searchsorted(node, node[-1])) if len(node) else 0  # the last bucket may go on
        if whole:
            yield _alike(t.slice(0, whole))
        held = t.slice(whole)
    if held is not None and held.num_rows:
        yield _alike(held)


def _alike(t: pa.Table) -> pa.RecordBatch:
    node, r = t["node"].to_numpy(), t["r"].to_numpy()
    m = np.array(t["m"].combine_chunks().flatten()).reshape(len(r), -1)
    forest = Forest(len(r))
    first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    size = np.diff(np.r_[first, len(r)])
    tiny = np.repeat(size <= TINY, size)
    for k in range(1, min(TINY, int(size.max()))):
        i = np.flatnonzero(tiny[:-k] & (node[k:] == node[:-k]))
        for low in range(0, len(i), 50_000):
            p = i[low : low + 50_000]
            p = p[(m[p] == m[p + k]).sum(1) >= SHARED]
            forest.join(p, p + k)
    for at, n in zip(first[size > TINY], size[size > TINY]):
        for low in range(at, at + n, ROWS):
            part = m[low : min(low + ROWS, at + n)]
            same = np.zeros((len(part), at + n - low), np.uint8)
            for k in range(m.shape[1]):
                same += part[:, k, None] == m[None, low : at + n, k]
            i, j = np.nonzero(same >= SHARED)
            forest.join(i + low, j + low)
    own = np.flatnonzero(forest.least != np.arange(len(r)))
    return pa.RecordBatch.from_arrays([pa.array(r[own]), pa.array(r[forest.least[own]])], names=["a", "b"])


class Forest:
    """The least place that each of n places hangs together with, kept while links are added."""

    def __init__(self, n: int):
        self.least = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.least[a], self.least[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.least, np.maximum(x, y), np.minimum(x, y))
            while (self.least[self.least] != self.least).any():
                self.least = self.least[self.least]


def candidates(sets: DataFrame) -> DataFrame:
    """(a, b): links between representatives r of sets (r, m) that hold every candidate pair in one component."""
    root = F.explode(F.array(*[_split(F.lit(k), F.lit(k * COORDINATES // RUNS)) for k in range(RUNS)])).alias("node")
    nodes = sets.select("r", root)
    found: list[DataFrame] = []
    for depth in range(1, DEPTH + 1):
        sizes = nodes.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
        met = cut(nodes.join(sizes, "node").join(sets, "r").select("node", "n", "r", "m"))
        # a small bucket has at most SMALL sets, so it is gathered whole
        small = met.where(F.col("n") <= SMALL).select("node", "r", "m")
        found.append(cut(small.repartition("node").sortWithinPartitions("node").mapInArrow(_small_buckets, "a long, b long").distinct()))
        large = met.where(F.col("n") > SMALL)
        if large.isEmpty():
            break
        sampled = [F.pmod(F.xxhash64("node", F.lit(k)), F.lit(COORDINATES)).cast("int") for k in range(SPLITS)]
        children = [_split(F.col("node"), c) for c in sampled]
        # how alike a bucket's sets are shows before any row is copied into its children: the share of pairs that meet in one
        alike = None
        for k, child in enumerate(children):
            one = large.groupBy("node", "n", child.alias("child")).agg(F.count("*").alias("c"))
            one = one.groupBy("node").agg(F.sum(F.col("c") * F.col("c") / (F.col("n") * F.col("n"))).alias(f"alike{k}"))
            alike = one if alike is None else alike.join(one, "node")
        total = sum((F.col(f"alike{k}") for k in range(SPLITS)), F.lit(0.0))
        whole = alike.select("node", ((total >= 1) | F.lit(depth == DEPTH)).alias("whole"))
        judged = cut(large.join(whole, "node").select("node", "r", "whole", *[c.alias(f"c{k}") for k, c in enumerate(children)]))
        stars = judged.where("whole")
        found.append(cut(stars.join(stars.groupBy("node").agg(F.min("r").alias("b")), "node").select(F.col("r").alias("a"), "b").distinct()))
        nodes = judged.where("not whole").select("r", F.explode(F.array(*[f"c{k}" for k in range(SPLITS)])).alias("node"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return cut(out.where("a <> b").distinct())


def _blocks(b: pa.Table) -> pa.Table:
    """Links of the sets of one block, or of two blocks of one group: for each set the weight of its links, and a spanning forest."""
    size, r, weight, block = (b[c].to_numpy() for c in ("size", "r", "weight", "block"))
    order = np.lexsort((r, size))
    size, r, weight, block = size[order], r[order], weight[order], block[order]
    lists = b["s"].combine_chunks()
    values, offsets = np.array(lists.flatten()), np.array(lists.offsets, np.int64)
    offsets = offsets - offsets[0]
    # columns are the shingles of more than one set, the others are in no intersection
    owner = np.empty(len(order), np.int64)
    owner[order] = np.arange(len(order))
    owner = np.repeat(owner, np.diff(offsets))
    by = np.argsort(values, kind="stable")
    values, owner = values[by], owner[by]
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    column = np.cumsum(new) - 1
    common = np.bincount(column)[column] > 1 if len(column) else np.zeros(0, bool)
    owner, column = owner[common], column[common]
    by = np.lexsort((column, owner))
    owner, column = owner[by], column[by]
    first = np.searchsorted(owner, np.arange(len(order) + 1))
    links, forest = np.zeros(len(order), np.int64), Forest(len(order))
    across = b["i"][0].as_py() != b["j"][0].as_py()  # pairs inside a block are counted with that block
    for low in range(0, len(order), ROWS):
        up = min(low + ROWS, len(order))
        for low2 in range(low, len(order), ROWS):
            up2 = min(low2 + ROWS, len(order))
            if DENOMINATOR * size[up - 1] < NUMERATOR * size[low2]:
                break  # sets are in order of size, and so unlike ones can't reach the likeness
            both = _intersections(column, first, low, up, low2, up2)
            linked = DENOMINATOR * both >= NUMERATOR * (size[low:up, None] + size[None, low2:up2] - both)
            if across:
                linked &= block[low:up, None] != block[None, low2:up2]
            if low == low2:
                linked &= ~np.eye(up - low, dtype=bool)
                links[low:up] += linked @ weight[low2:up2]
            else:
                links[low:up] += linked @ weight[low2:up2]
                links[low2:up2] += linked.T @ weight[low:up]
            forest.join(*(k + at for k, at in zip(np.nonzero(linked), (low, low2))))
    some = (links > 0) | (forest.least != np.arange(len(order)))
    return pa.table({"a": pa.array(r[some]), "b": pa.array(r[forest.least[some]]), "links": pa.array(links[some])})


def _intersections(column: np.ndarray, first: np.ndarray, low: int, up: int, low2: int, up2: int) -> np.ndarray:
    """Sizes of the intersections of sets low to up - 1 with sets low2 to up2 - 1; set k has the sorted columns first[k] to first[k + 1] - 1."""
    x, y = column[first[low] : first[up]], column[first[low2] : first[up2]]
    own_x = np.repeat(np.arange(up - low), np.diff(first[low : up + 1]))
    own_y = np.repeat(np.arange(up2 - low2), np.diff(first[low2 : up2 + 1]))
    shared = np.intersect1d(x, y)
    keep_x, keep_y = np.searchsorted(shared, x), np.searchsorted(shared, y)
    both = np.zeros((up - low, up2 - low2), np.int64)
    if not len(shared):
        return both
    ok_x, ok_y = shared[np.minimum(keep_x, len(shared) - 1)] == x, shared[np.minimum(keep_y, len(shared) - 1)] == y
    own_x, keep_x, own_y, keep_y = own_x[ok_x], keep_x[ok_x], own_y[ok_y], keep_y[ok_y]
    for at in range(0, len(shared), COLUMNS):
        wide = min(COLUMNS, len(shared) - at)
        a, b = np.zeros((up - low, wide), np.float32), np.zeros((up2 - low2, wide), np.float32)
        some = (keep_x >= at) & (keep_x < at + wide)
        a[own_x[some], keep_x[some] - at] = 1
        some = (keep_y >= at) & (keep_y < at + wide)
        b[own_y[some], keep_y[some] - at] = 1
        both += (a @ b.T).astype(np.int64)
    return both


def _bits(key: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(k)), F.lit(FILTER)) for k in range(3)]


def _may_be(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of docs (d, text) without most of those whose d isn't among keys (d0), by a Bloom filter of FILTER bits."""
    places = keys.select(F.explode(F.array(*_bits(F.col("d0")))).alias("bit"))
    words = places.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int"))).alias("bits")).toArrow()
    table = np.zeros(FILTER >> 6, np.uint64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            for k in range(3):
                bit = b.column(f"b{k}").to_numpy()
                keep &= (shared.value[bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            yield b.select(["d", "text"]).filter(pa.array(keep))

    rows = docs.select("d", "text", *[c.alias(f"b{k}") for k, c in enumerate(_bits(F.col("d")))])
    return rows.mapInArrow(run, docs.select("d", "text").schema)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, j, w in chunks(b):
            text, s = shingles(w)
            part = b.slice(i, j - i)
            offsets = np.searchsorted(text, np.arange(j - i + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(s.view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(c) for c in ("r", "g", "nb", "weight", "size")] + [lists], names=["r", "g", "nb", "weight", "size", "s"])


def similar(docs: DataFrame) -> DataFrame:
    """(d, class_id, n_links) for each row of docs (d, text); d is of any type that has an order, and rows of one d have one text.

    Rows link if the sets of their five-word shingles (a text of one to four words is one shingle) have a Jaccard
    likeness of 0.8 or more; n_links counts the other rows that a row links with, rows with equal sets among them, and
    class_id is the least d that links reach. A null text, or one without words, links with nothing. Repeated rows and
    copies are one set, very long texts one set each; an empty table gives an empty one.
    """
    rows = cut(embeddings(docs))
    full = rows.where("x is not null")
    reps = full.groupBy("x", "y").agg(F.min("d").alias("d0"), F.first("size").alias("size"), F.first("m").alias("m"), F.count("*").alias("weight"))
    reps = cut(reps.withColumnRenamed("x", "r"))
    links = candidates(reps.select("r", "m"))
    met = links.select(F.col("a").alias("id")).union(links.select("b")).distinct()
    groups = cut(components(met, links.select(F.col("a").alias("src"), F.col("b").alias("dst"))).select(F.col("id").alias("r"), F.col("component").alias("g")))
    groups = groups.join(reps.select("r", "d0", "size", "weight"), "r")
    # a block has about as many sets, and shingles, as the constants say
    sizes = groups.groupBy("g").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("nb"))
    members = cut(groups.join(sizes, "g"))
    chosen = _may_be(docs, members.select("d0"))  # so that few other texts are shuffled
    texts = chosen.join(members, chosen["d"] == members["d0"]).select("r", "g", "nb", "weight", "size", "text").dropDuplicates(["r"])
    sets = texts.mapInArrow(_sets, "r long, g long, nb int, weight long, size long, s array<long>")
    block = F.pmod(F.xxhash64("r", F.lit(1)), F.col("nb").cast("long")).cast("int")
    sets = sets.withColumn("block", block).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    pairs = sets.select("g", "r", "weight", "size", "s", "block", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"))
    linked = cut(pairs.groupBy("g", "i", "j").applyInArrow(_blocks, "a long, b long, links long"))
    merged = linked.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    classes = components(linked.select(F.col("a").alias("id")).union(linked.select("b")).distinct(), merged)
    classes = cut(classes.select(F.col("id").alias("r"), F.col("component").alias("c")).join(reps.select("r", "d0"), "r"))
    classes = classes.join(classes.groupBy("c").agg(F.min("d0").alias("class_id")), "c").select("r", "class_id")
    counts = linked.groupBy(F.col("a").alias("r")).agg(F.sum("links").alias("links"))
    found = reps.select("r", "y", "d0", "weight").join(counts, "r", "left").join(classes, "r", "left")
    found = found.select(F.col("r").alias("x"), "y", F.coalesce("class_id", "d0").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    known = full.select("d", "x", "y").join(found, ["x", "y"]).select("d", "class_id", "n_links")
    return known.unionByName(rows.where("x is null").select("d", F.col("d").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_links, kept) of docs (doc_id, text); see `similar`. kept: the row is its class's least.

    A null doc_id counts as larger than all others and its class, if no other id is in it, is null. Of rows that share an
    id, or have none, the one whose text has the least hash is the least; equal rows are all kept or not. Other columns are
    not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(row_key("doc_id", "text").alias("d"), "text")
    own = lambda c: F.when(~F.col(f"{c}.none"), F.col(f"{c}.id")).cast(kind)
    return similar(rows).select(own("d").alias("doc_id"), own("class_id").alias("class_id"), "n_links", (F.col("d") == F.col("class_id")).alias("kept"))
