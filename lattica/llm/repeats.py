"""Removal of repeated word windows by recompression.

Every text is parsed bottom up in rounds. Runs of a word and then, in each round, pairs (left, right) of neighbouring
symbols get new names, where a global coin per symbol and round says which symbols are left and which right. A name is
a hash of what it stands for, so it is the same in every document without a dictionary that tasks would have to
share. With each symbol goes the stretch of words that its forming depended on: a window that holds that stretch holds
the symbol, wherever the window's words occur. A window's anchor is the least name of the longest kind of symbols it so
holds (see RANKS); neighbouring windows with one anchor are a stretch.

Stretches are compared in Spark. Anchors that occur once are done with. For the others, equal stretches (by a hash of
all their words) need only their first place, and of unlike stretches that share an anchor the first ones are
compared window by window. So every repeated window is found, and copies cost no more than their stretches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import Words, chunks, mix64, span_hashes
from lattica.plans.lineage import cut

WINDOW = 20
ROUNDS = 4
#: An anchor is one of so many words if the window has one, else one of so many ...
RANKS = (4, 3, 2)
#: Windows of a stretch, at most, and the bit that marks a stretch in which a window occurs twice.
STRETCH, _TWICE = 16, 64
#: Bits of an anchor in comparison: anchors that agree by chance only cost a closer look.
ANCHOR = 40
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_LAST = (1 << 63) - 1


def _named(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    return mix64(a * np.uint64(0x9E3779B97F4A7C15) + mix64(b ^ np.uint64(0xC2B2AE3D27D4EB4F * salt & (1 << 64) - 1)))


def symbols(h: np.ndarray, first: np.ndarray, rounds: int = ROUNDS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(names, words, low, high) of the symbols that each round makes; words low to high - 1 decide that a symbol forms.

    h: names of the words; first: the first word of each text and the end. Round 0 are the words themselves. A symbol
    whose forming depends on where its text begins or ends has a stretch beyond the text.
    """
    n = len(h)
    name, low, high = h, np.arange(n), np.arange(1, n + 1)
    yield name, high - low, low, high
    edge = np.zeros(n + 1, bool)  # between symbols i - 1 and i
    edge[first] = True
    edge[[0, n]] = True
    # runs of a word: what stands before and after decides
    new = edge[:-1].copy()
    new[1:] |= h[1:] != h[:-1]
    at = np.flatnonzero(new)
    size = np.diff(np.r_[at, n])
    many = size > 1
    name = np.where(many, _named(h[at], size.astype(np.uint64), 1), h[at])
    low, high = at - 1, at + size + 1
    edge = np.r_[edge[at], True]
    yield name[many], size[many], low[many], high[many]
    for k in range(1, rounds + 1):
        if len(name) < 2:
            return
        right = (mix64(name ^ np.uint64(0xA0761D6478BD642F * k & (1 << 64) - 1)) >> np.uint64(63)).astype(bool)
        pair = np.zeros(len(name), bool)
        pair[:-1] = ~right[:-1] & right[1:] & ~edge[1:-1]
        i = np.flatnonzero(pair)
        made = _named(name[i], name[i + 1], 2 * k + 1)
        yield made, size[i] + size[i + 1], np.minimum(low[i], low[i + 1]), np.maximum(high[i], high[i + 1])
        # a left symbol stays single because of the one after it, a right one because of the one before
        after_low, after_high = np.r_[low[1:], n], np.r_[high[1:], n]
        before_low, before_high = np.r_[0, low[:-1]], np.r_[0, high[:-1]]
        at_end, at_start = edge[1:], edge[:-1]
        new_low = np.where(right, np.where(at_start, low - WINDOW - 1, np.minimum(low, before_low)), np.where(at_end, low, np.minimum(low, after_low)))
        new_high = np.where(right, np.where(at_start, high, np.maximum(high, before_high)), np.where(at_end, high + WINDOW + 1, np.maximum(high, after_high)))
        name, size = name.copy(), size.copy()
        size[i] += size[i + 1]
        name[i], new_low[i], new_high[i] = made, np.minimum(low[i], low[i + 1]), np.maximum(high[i], high[i + 1])
        stay = np.ones(len(name), bool)
        stay[i + 1] = False
        edge = np.r_[edge[:-1][stay], True]
        name, size, low, high = name[stay], size[stay], new_low[stay], new_high[stay]


def anchors(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each word the anchor of the window that starts with it (garbage where no window of one text starts)."""
    n = len(h)
    least = [np.full(n + 1, _NONE) for _ in range(5)]
    for name, size, low, high in symbols(h, first):
        rank = np.searchsorted(-np.array(RANKS), -size, "left").astype(np.uint64)
        value = (name >> np.uint64(2)) | rank << np.uint64(62)
        lo, hi = np.maximum(high - WINDOW, 0), low
        ok = (hi >= lo) & (hi < n)
        lo, hi, value = lo[ok], hi[ok], value[ok]
        log = np.frexp(hi - lo + 1)[1] - 1
        for j in range(5):
            of = log == j
            if of.any():
                np.minimum.at(least[j], lo[of], value[of])
                np.minimum.at(least[j], hi[of] - (1 << j) + 1, value[of])
    for j in range(4, 0, -1):
        half = 1 << (j - 1)
        np.minimum(least[j - 1], least[j], out=least[j - 1])
        np.minimum(least[j - 1][half:], least[j][:-half], out=least[j - 1][half:])
    return least[0][:n]


def stretches(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start in its text, windows, anchor, hash) of the stretches of some texts; windows has the bit _TWICE added."""
    h, first = words.hashes(), words.first
    n = len(h)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    start = np.flatnonzero(np.arange(n) + WINDOW <= first[1:][row]) if n else np.zeros(0, int)
    if not len(start):
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    anchor = anchors(h, first)[start]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[start[1:]] != row[start[:-1]])
    begin = np.flatnonzero(new)
    place = np.arange(len(start)) - np.repeat(begin, np.diff(np.r_[begin, len(start)]))
    begin = np.flatnonzero(place % STRETCH == 0)
    size = np.diff(np.r_[begin, len(start)])
    number = np.repeat(np.arange(len(begin)), size)
    window = span_hashes(h, start, start + WINDOW)
    twice = np.zeros(len(begin), bool)
    for k in range(1, STRETCH):
        same = np.flatnonzero((window[k:] == window[:-k]) & (number[k:] == number[:-k]))
        twice[number[same]] = True
    at = start[begin]
    return row[at], at - first[row[at]], size + _TWICE * twice, anchor[begin], span_hashes(h, at, at + size + WINDOW - 1)


def _arrow(names: str, *columns: np.ndarray | pa.Array) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64)) for c in columns]
    return pa.RecordBatch.from_arrays(arrays, names=list(names))


def _spans(words: Words, column: pa.Array, size: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, size) of the spans of some texts, from a column of lists of (l, size)."""
    offsets = np.array(column.offsets)
    flat = column.values.slice(offsets[0], offsets[-1] - offsets[0])
    text = np.repeat(np.arange(len(column)), np.diff(offsets))
    return text, words.first[text] + flat.field("l").to_numpy(zero_copy_only=False), flat.field(size).to_numpy(zero_copy_only=False)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(d, t, spans): for each key of docs (d, t, text) the spans (l, words) covered by repeated windows; l is a word's place."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, w in chunks(b):
                row, start, size, anchor, whole = stretches(w)
                if len(row):
                    d, t = (b.column(c).slice(i, j - i).to_numpy()[row] for c in "dt")
                    yield _arrow("ardtlc", mix64(anchor) >> np.uint64(64 - ANCHOR), whole, d, t, start, size)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, w in chunks(b):
                text, at, n = _spans(w, b.column("spans").slice(i, j - i), "c")
                n = n % _TWICE
                text, at = np.repeat(text, n), np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())
                d, t = (b.column(c).slice(i, j - i).to_numpy()[text] for c in "dt")
                yield _arrow("wdtl", span_hashes(w.hashes(), at, at + WINDOW), d, t, at - w.first[text])

    place = F.struct("d", "t", "l")
    stretch = docs.mapInArrow(parse, "a long, r long, d long, t long, l long, c long")
    common = stretch.groupBy("a").agg(F.count("*").alias("n"), F.max("c").alias("most")).where((F.col("n") > 1) | (F.col("most") >= _TWICE)).select("a")
    shared = cut(stretch.join(common, "a"))
    firsts = cut(shared.groupBy("a", "r").agg(F.min(place).alias("first"), F.max("c").alias("c")).select("a", "r", "first.*", "c"))
    unlike = firsts.groupBy("a").agg(F.count("*").alias("kinds"), F.max("c").alias("most")).where((F.col("kinds") > 1) | (F.col("most") >= _TWICE)).select("a")
    first = firsts.select("a", "r", place.alias("first"))
    later = shared.join(first, ["a", "r"]).where(place > F.col("first")).select("d", "t", "l", (F.col("c") % _TWICE + WINDOW - 1).alias("words"))
    parts = firsts.join(unlike, "a").groupBy("d", "t").agg(F.collect_set(F.struct("l", "c")).alias("spans"))
    # windows of unlike stretches only; a window's first place is a sum that map tasks begin, and the join with it splits
    single = cut(docs.join(parts, ["d", "t"]).mapInArrow(windows, "w long, d long, t long, l long"))
    first = single.groupBy("w").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("w", "first")
    again = single.join(first, "w").where(place > F.col("first")).select("d", "t", "l", F.lit(WINDOW).cast("long").alias("words"))
    return later.unionByName(again).groupBy("d", "t").agg(F.collect_set(F.struct("l", "words")).alias("spans"))


def remove_repeats(docs: DataFrame, text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, and kept, the words left, if text) of docs (doc_id, text).

    A word goes if a window of WINDOW words of its text that covers it also starts earlier: in a smaller doc_id (null is
    the largest) or earlier in the same text; of texts that share an id, or have none, the one with the smaller hash is
    earlier, and equal rows count as one. A null text has no words; a text shorter than a window loses none. Texts of any
    length are read whole, an empty table gives an empty one, and other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"), "text")

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, w in chunks(b):
                n, gone, sha, kept = [], [], [], []
                data = w.data.tobytes()
                change = np.zeros(len(w.starts) + 1, np.int64)
                where, at, size = _spans(w, b.column("spans").slice(i, j - i), "words")
                np.add.at(change, at, 1)
                np.add.at(change, np.minimum(at + size, w.first[where + 1]), -1)
                drop = np.cumsum(change)[:-1] > 0
                for k in range(j - i):
                    all_words = data[w.offsets[k] : w.offsets[k + 1]].split()
                    mine = drop[w.first[k] : w.first[k + 1]]
                    left = b" ".join([x for x, d in zip(all_words, mine.tolist()) if not d] if mine.any() else all_words)
                    n.append(len(all_words))
                    gone.append(int(mine.sum()))
                    sha.append(hashlib.sha256(left).hexdigest())
                    kept.append(left.decode() if text else None)
                columns = [b.column("d").slice(i, j - i), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.string())] * text, names=["d", "n_words", "n_removed", "kept_sha256"] + ["kept"] * text)

    out = rows.join(repeated_spans(rows), ["d", "t"], "left").mapInArrow(rest, "d long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * text)
    return out.select(F.when(F.col("d") != _LAST, F.col("d")).cast(kind).alias("doc_id"), "n_words", "n_removed", "kept_sha256", *["kept"] * text)
