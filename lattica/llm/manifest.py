"""A Merkle manifest of a dataset: one root for all rows, one subroot for each source, and a proof for each row.

A row's place in its source comes from a radix trie and not from a sort of all rows: digits of the key are counted,
prefix sums of the counts give every digit's first place, and only prefixes that hold too many rows are opened further.
Rows are then numbered inside their own prefix. The tree's nodes are keyed by the digits, in base FANOUT, of their
leaves' places: a node is the prefix that its leaves share, and nodes are reduced by the longest prefix first, LEVELS
digits at a time. The way back down gives each leaf the siblings on its way to the root.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.plans.lineage import cut

#: Nodes that become one.
FANOUT = 16
#: Levels of the tree that one shuffle reduces; FANOUT ** LEVELS nodes are a task's unit.
LEVELS = 3
#: Hexadecimal digits of a key that one round counts, and rows above which a prefix is opened further.
DIGITS, OPENED = 3, 20_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """A value as it goes into a leaf: - if null, else its UTF-8 byte count, a colon, and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(doc_id: str = "doc_id", source: str = "source", lang: str = "lang", n_chars: str = "n_chars", text: Column | str = "text") -> Column:
    """A row's leaf: the lowercase hex SHA-256 of its fields."""
    text = F.col(text) if isinstance(text, str) else text
    return F.sha2(F.concat(*[field(F.col(c)) for c in (doc_id, source, lang, n_chars)], field(text)), 256)


def ranked(rows: DataFrame, group: str, key: str, opened: int = OPENED) -> DataFrame:
    """rows with rank, from 0, in ascending byte order of a hexadecimal key inside their group, and n, the group's rows.

    Keys are unique in a group and not empty, groups are not null. A round opens the prefixes of more than `opened` rows:
    it skips the digits that all their keys share, and counts DIGITS more. Prefix sums run below one prefix only, over at
    most 16 ** DIGITS counts, and rows are numbered inside a prefix of at most `opened` rows.
    """
    here = ["_g", "_p"]
    placed = rows.withColumns({"_g": F.col(group), "_p": F.lit("")})
    level = cut(placed.groupBy(*here).agg(F.count("*").alias("_c")).select(*here, "_c", F.lit(0).cast("long").alias("_start"), F.col("_c").alias("n")))
    starts = level.where(F.col("_c") <= opened)
    while not (wide := level.where(F.col("_c") > opened)).isEmpty():
        ends = placed.join(wide.select(*here), here, "left_semi").groupBy(*here).agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
        shared = F.size(F.filter(F.sequence(F.lit(1), F.length("lo")), lambda i: F.substring("lo", F.lit(1), i) == F.substring("hi", F.lit(1), i)))
        opens = cut(wide.join(ends, here).select(*here, F.col("_start").alias("_base"), "n", (shared + DIGITS).alias("_to")))
        deeper = F.substring(F.col(key), F.lit(1), F.col("_to"))
        counts = placed.join(opens, here).groupBy(*here, "_base", "n", deeper.alias("_child")).agg(F.count("*").alias("_c"))
        before = F.sum("_c").over(Window.partitionBy(*here).orderBy("_child").rowsBetween(Window.unboundedPreceding, -1))
        level = cut(counts.select("_g", F.col("_child").alias("_p"), "_c", (F.col("_base") + F.coalesce(before, F.lit(0))).alias("_start"), "n"))
        starts = starts.unionByName(level.where(F.col("_c") <= opened))
        placed = placed.join(opens.select(*here, "_to"), here, "left").withColumn("_p", F.when(F.col("_to").isNull(), F.col("_p")).otherwise(deeper)).drop("_to")
    place = F.row_number().over(Window.partitionBy(*here).orderBy(key)) - 1
    return placed.withColumn("_place", place).join(starts.select(*here, "_start", "n"), here).select(*rows.columns, (F.col("_start") + F.col("_place")).alias("rank"), "n")


def _h(parts: Iterable[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def _levels(digests: list[str], height: int) -> list[list[str]]:
    """A unit's nodes, and those that they become level by level, LEVELS levels at most."""
    levels = [digests]
    for _ in range(min(LEVELS, height)):
        below = levels[-1]
        levels.append([_h(below[i : i + FANOUT]) for i in range(0, len(below), FANOUT)])
    return levels


def _reduce(key: tuple, unit: pa.Table) -> pa.Table:
    """A unit's nodes become the node above them, LEVELS levels up or at the root."""
    unit = unit.sort_by("rank")
    height = unit.column("height")[0].as_py()
    top = _levels(unit.column("digest").to_pylist(), height)[-1]
    return pa.table({"tree": [key[0].as_py()], "rank": pa.array([key[1].as_py()], pa.int64()), "height": pa.array([max(0, height - LEVELS)], pa.int32()), "digest": top})


def grown(leaves: DataFrame) -> list[DataFrame]:
    """Nodes (tree, rank, height, digest) of leaves (the same columns, and more), then of every third level above, up to one root a tree.

    height: how many levels are still to come.
    """
    stages = [leaves]
    while not stages[-1].where("height > 0").isEmpty():
        below = stages[-1].select("tree", "rank", "height", "digest", F.shiftrightunsigned("rank", LEVELS * 4).alias("unit"))
        stages.append(cut(below.groupBy("tree", "unit").applyInArrow(_reduce, "tree string, rank long, height int, digest string")))
    return stages


def height(n: Column) -> Column:
    """Levels above n leaves: the hexadecimal digits of the last place, none for a lone leaf."""
    return F.when(n > 1, F.length(F.hex(n - 1))).otherwise(0).cast("int")


def _ways(digests: list[str], height: int) -> tuple[list[list[str]], Callable[[int], list[tuple[int, list[str]]]]]:
    """A unit's levels, and for each of its nodes the runs that it and its ancestors in the unit are in, with their places there."""
    levels = _levels(digests, height)

    def way(i: int) -> list[tuple[int, list[str]]]:
        out = []
        for level in levels[:-1]:
            start = i - i % FANOUT
            out.append((i - start, level[start : start + FANOUT]))
            i //= FANOUT
        return out

    return levels, way


def _packed(way: list[tuple[int, list[str]]]) -> str:
    """A way as text: for each level one hexadecimal digit for the place, one for the number of siblings, and the siblings."""
    return "".join(f"{at:x}{len(run) - 1:x}" + "".join(run[:at] + run[at + 1 :]) for at, run in way)


def _unpacked(text: str) -> list[tuple[int, list[str]]]:
    out, i = [], 0
    while i < len(text):
        at, n = int(text[i], 16), int(text[i + 1], 16)
        out.append((at, [text[i + 2 + 64 * k : i + 66 + 64 * k] for k in range(n)]))
        i += 2 + 64 * n
    return out


def _descend(nodes: pa.Table, above: pa.Table) -> pa.Table:
    """The way to the root of each node of a unit: its own runs, and then the way of the node that the unit becomes."""
    nodes = nodes.sort_by("rank")
    _, way = _ways(nodes.column("digest").to_pylist(), nodes.column("height")[0].as_py())
    rest = above.column("way")[0].as_py()
    ways = [_packed(way(i)) + rest for i in range(nodes.num_rows)]
    same = {c: above.column(c).take(pa.array([0] * nodes.num_rows)) for c in ("subroot", "root")}
    return pa.table({"tree": nodes.column("tree"), "rank": nodes.column("rank"), "way": ways, **same})


def _prove(nodes: pa.Table, above: pa.Table) -> pa.Table:
    """For each leaf of a unit the hash of its siblings up to the root, and the root that its claimed digest folds to."""
    nodes = nodes.sort_by("rank")
    _, way = _ways(nodes.column("digest").to_pylist(), nodes.column("height")[0].as_py())
    rest = _unpacked(above.column("way")[0].as_py())
    joined = "".join("".join(siblings) for _, siblings in rest).encode()
    proofs, folded = [], []
    for i, claim in enumerate(nodes.column("claim").to_pylist()):
        proof = sha256()
        for at, run in way(i):
            proof.update("".join(run[:at] + run[at + 1 :]).encode())
            claim = _h([*run[:at], claim, *run[at + 1 :]])
        proof.update(joined)
        for at, siblings in rest:
            claim = _h([*siblings[:at], claim, *siblings[at:]])
        proofs.append(proof.hexdigest())
        folded.append(claim)
    same = {c: above.column(c).take(pa.array([0] * nodes.num_rows)) for c in ("subroot", "root")}
    return pa.table({"doc_id": nodes.column("doc_id"), "leaf": nodes.column("digest"), **same, "proof_sha256": proofs, "folded_root": folded})


def _downward(stage: DataFrame, ways: DataFrame, step: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    nodes = stage.withColumn("unit", F.shiftrightunsigned("rank", LEVELS * 4))
    return nodes.groupBy("tree", "unit").cogroup(ways.withColumnRenamed("rank", "unit").groupBy("tree", "unit")).applyInArrow(step, schema)


WAYS = "tree string, rank long, way string, subroot string, root string"


def descended(stages: list[DataFrame], ways: DataFrame) -> DataFrame:
    """Ways (tree, rank, way, subroot, root) of the second stage's nodes, from those of the last one's, the roots."""
    for stage in reversed(stages[1:-1]):
        ways = _downward(stage, ways, _descend, WAYS)
    return ways


def manifest(docs: DataFrame, tampered: Column | None = None, fanned: int = OPENED) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of docs (doc_id, source, lang, n_chars, text); more columns don't matter.

    tampered: a condition; where it holds (and isn't null), folded_root is of the row with A to Z of its text in lower
    case. Null sources are one source, the first. Rows of a source ascend by doc_id, null ones last; rows of one doc_id
    ascend by their leaves, and equal rows follow each other. A lone row is its own subroot, a lone subroot the root;
    a row without any siblings has the hash of nothing as its proof. No rows give no rows.
    """
    changed = digest(text=F.translate("text", _UPPER, _LOWER))
    leaf = digest()
    tree = F.coalesce(F.concat(F.lit("1"), F.col("source").cast("string")), F.lit("0"))
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tree.alias("tree"), leaf.alias("digest"), F.when(F.lit(False) if tampered is None else tampered, changed).alias("changed"))
    given = cut(given.withColumn("_n", F.monotonically_increasing_id()))  # written, so that the numbers of equal rows stay
    digits = F.lpad(F.hex(F.col("doc_id").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")  # the sign turned, so that they order as numbers
    key = F.concat(F.coalesce(digits, F.lit("~")), "digest", F.lpad(F.hex("_n"), 16, "0"))
    leaves = ranked(given.withColumn("_key", key), "tree", "_key", fanned)
    leaves = cut(leaves.select("tree", "rank", height(F.col("n")).alias("height"), "doc_id", "digest", F.coalesce("changed", "digest").alias("claim")))

    stages = grown(leaves)
    subroots = stages[-1].select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest")
    subroots = cut(ranked(subroots.withColumn("_key", F.hex(F.col("source").cast("binary"))), "tree", "_key", fanned))
    forest = grown(subroots.select("tree", "rank", height(F.col("n")).alias("height"), "digest"))
    roots = forest[-1].select("tree", "rank", F.lit("").alias("way"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    ways = _downward(forest[0], descended(forest, roots), _descend, WAYS) if len(forest) > 1 else roots
    tops = subroots.join(ways.select("rank", "way", "root"), "rank").select(F.col("source").alias("tree"), F.lit(0).cast("long").alias("rank"), "way", F.col("digest").alias("subroot"), "root")
    out = _downward(leaves, descended(stages, cut(tops)), _prove, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
