"""Scores of a Brown class-based bigram model: P(word | before) = P(class | class before) * P(word | class).

All words are counted, as 64-bit hashes. Words that occur EXCHANGED times or more, and are above LOOKED_UP of all tokens,
get their classes by exchange clustering, so they grow with the corpus until there are 1 / LOOKED_UP of them; all others
have the class of their shape. What a word stands next to is one row of a table, so each round of the exchange reads
rows and shuffles nothing; only the words' classes and the class bigrams are held whole. A word above LOOKED_UP is
looked up in a broadcast table when texts are scored, the rarer ones by a join with the counted words, so what is
broadcast has a bound at any size and no rare word is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import Words, chunks, lower_ascii, string_buffers
from lattica.plans.lineage import cut

CLASSES = 64
ROUNDS = 8
EXCHANGED, LOOKED_UP = 20, 1e-6
#: What is added to a word's count.
ADDED = 0.1

_SHAPES = 16
_END_SHAPE = _SHAPES  # the class of the end token, also what stands before a text
_END = np.uint64(0xE9D3F1A5C7B80241)  # the end token's hash
_MERGE = 3_000_000  # counts that a task gathers before it adds equal keys


def tokens(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and shape of each token of some texts, ends included, and the first token of each text."""
    data = lower_ascii(words.data)
    n = np.diff(words.first)
    first = words.first + np.arange(len(words.first))
    at = np.ones(first[-1], bool)
    at[first[1:] - 1] = False
    kinds = np.zeros(len(data) + 1, np.int64)
    np.cumsum(np.where(data >= 128, 1, np.where((data >= 97) & (data <= 122), 0, 1 << 32)), out=kinds[1:])
    kinds = kinds[words.ends] - kinds[words.starts]
    shape = np.minimum(3, (words.ends - words.starts - 1) // 3) * 4 + ((kinds & 0xFFFFFFFF) > 0) * 2 + (kinds >= 1 << 32)
    hashes, shapes = np.full(first[-1], _END), np.full(first[-1], _END_SHAPE)
    hashes[at], shapes[at] = words.hashes(data), shape
    assert len(n) == len(first) - 1
    return hashes, shapes, first


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    return keys[new], np.add.reduceat(counts, new) if len(new) else counts


def _counted(parts: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Counts of the 64-bit keys in all parts; equal keys are added whenever _MERGE have gathered."""
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    many = 0
    for keys in parts:
        kept.append(_sums(keys, np.ones(len(keys), np.int64)))
        many += len(kept[-1][0])
        if many > _MERGE:
            kept = [_sums(np.concatenate([k for k, _ in kept]), np.concatenate([c for _, c in kept]))]
            many = len(kept[0][0])
            if many > _MERGE // 2:
                yield from _batches(*kept[0])
                kept, many = [], 0
    if kept:
        yield from _batches(*_sums(np.concatenate([k for k, _ in kept]), np.concatenate([c for _, c in kept])))


def _batches(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    keys = keys.astype(np.uint64).view(np.int64)
    for at in range(0, len(keys), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 100_000]), pa.array(counts[at : at + 100_000])], names=["key", "n"])


def count_words(docs: DataFrame) -> DataFrame:
    """(key, n): how often each token occurs in the texts of docs; the low 5 bits of a key are its shape, the others its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _counted(_keys(*tokens(w)[:2]) for b in batches for _, _, w in chunks(b))

    return docs.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _keys(hashes: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    return (hashes & ~np.uint64(31)) | shapes.astype(np.uint64)


@dataclass
class Model:
    """keys, counts, classes: of the words that are looked up, by key; the tables hold log10 probabilities."""

    keys: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    n: int
    v: int
    transitions: np.ndarray
    class_n: np.ndarray
    class_v: np.ndarray


def exchange(pairs: DataFrame, words: int, counts: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the first `words` ids by exchange clustering, and the class bigram counts.

    pairs (key, n): counts of id pairs, key = left id * ids + right id; the ids from `words` on keep classes of their
    own. In each round half of the words move to the class that gives the class bigrams the highest likelihood.
    """
    spark = pairs.sparkSession
    fixed = _SHAPES + 1
    ids, d = words + fixed, classes + fixed
    cls = np.empty(ids, np.int16)
    cls[np.argsort(-counts[:words], kind="stable")] = np.arange(words) % classes
    cls[words:] = classes + np.arange(fixed)
    left, right = F.floor(F.col("key") / ids).cast("long"), F.col("key") % ids
    sides = F.array(F.struct(left.alias("id"), right.alias("o")), F.struct(right.alias("id"), (left + ids).alias("o")))
    # a word has at most two entries for each id, and so a row of bounded length
    rows = pairs.select("n", F.explode(sides).alias("x")).groupBy("x.id").agg(F.collect_list(F.struct("x.o", "n")).alias("c"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = b.column("c")
            flat, offsets = c.flatten(), np.array(c.offsets)
            at = pa.py_buffer((offsets - offsets[0]).astype(np.int32) * 8)
            columns = [pa.Array.from_buffers(pa.binary(), b.num_rows, [None, at, pa.py_buffer(np.ascontiguousarray(flat.field(x).to_numpy()))]) for x in "on"]
            yield pa.RecordBatch.from_arrays([b.column("id"), *columns], names=["id", "o", "n"])

    # as bytes a row is read again and again without a look at each entry
    rows = cut(rows.mapInArrow(pack, "id long, o binary, n binary"))

    def entries(b: pa.RecordBatch, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        (o, offsets), (n, _) = string_buffers(b.column("o")), string_buffers(b.column("n"))
        o = o.view(np.int64)
        return np.repeat(np.arange(b.num_rows), np.diff(offsets) // 8), o >= ids, cls[o % ids].astype(np.int64), n.view(np.int64)

    def bigrams(shared) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            both = np.zeros(d * d)
            for b in batches:
                at, before, other, n = entries(b, shared.value)
                own = shared.value[b.column("id").to_numpy()].astype(np.int64)[at]
                both += np.bincount((own * d + other)[~before], n[~before], d * d)
            some = np.flatnonzero(both)
            yield from _batches(some, both[some].astype(np.int64))

        got = rows.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
        both = np.zeros(d * d)
        both[got["key"].to_numpy()] = got["n"].to_numpy()
        return both.reshape(d, d)

    def best(shared, both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        logs = np.log(both + 0.5)
        whole = 2 * np.log(np.maximum(both.sum(1), both.sum(0))[:classes] + 1)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                b = b.filter(pa.array(b.column("id").to_numpy() < words))
                if b.num_rows:
                    at, before, other, n = entries(b, shared.value)
                    after, ahead = np.bincount((at * 2 + before) * d + other, n, b.num_rows * 2 * d).reshape(-1, 2, d).transpose(1, 0, 2)
                    gain = after @ logs.T[:, :classes] + ahead @ logs[:, :classes] - np.maximum(after.sum(1), ahead.sum(1))[:, None] * whole
                    yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(gain.argmax(1))], names=["id", "best"])

        got = rows.mapInArrow(run, "id long, best long").toArrow()
        return got["id"].to_numpy(), got["best"].to_numpy()

    for turn in range(rounds + 1):
        shared = spark.sparkContext.broadcast(cls)
        both = bigrams(shared)
        if turn < rounds and words:
            word, to = best(shared, both)
            movers = (word + turn) % 2 == 0
            cls = cls.copy()
            cls[word[movers]] = to[movers]
        shared.unpersist()
    return cls.astype(np.int64), both


def bigram_weight(both: np.ndarray) -> float:
    """The weight of class bigrams against classes alone, by deleted interpolation: each bigram is judged without itself."""
    given = (both - 1) / np.maximum(1, both.sum(1, keepdims=True) - 1)
    alone = (both.sum(0, keepdims=True) - 1) / max(1.0, both.sum() - 1)
    seen = both.sum()
    return float((both[given > alone].sum() + 1) / (seen + 2)) if seen else 0.5


def fit(docs: DataFrame, words: DataFrame) -> Model:
    """The model of the texts of docs, whose counted words (see `count_words`) are given."""
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = words.where(F.col("n") >= max(1.0, LOOKED_UP * total.n)).toArrow()
    keys, counts = top["key"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    shapes = (keys & np.uint64(31)).astype(np.int64)
    chosen = np.flatnonzero((counts >= EXCHANGED) & (shapes != _END_SHAPE))
    shared = docs.sparkSession.sparkContext.broadcast(keys[chosen])
    ids = len(chosen) + _SHAPES + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[np.ndarray]:
            for b in batches:
                for _, _, w in chunks(b):
                    hashes, shapes, first = tokens(w)
                    at = _find(shared.value, _keys(hashes, shapes))
                    at = np.where(at >= 0, at, len(shared.value) + shapes)
                    left = np.r_[len(shared.value) + _END_SHAPE, at[:-1]] if len(at) else at
                    yield (left * ids + at).astype(np.uint64)

        yield from _counted(parts())

    pairs = cut(docs.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))
    cls, both = exchange(pairs, len(chosen), counts[chosen])
    classes = CLASSES + shapes
    classes[chosen] = cls[: len(chosen)]
    class_n, class_v = np.zeros(len(both)), np.zeros(len(both))
    for s, n, v in words.groupBy((F.col("key").bitwiseAND(31)).alias("s")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        class_n[CLASSES + s], class_v[CLASSES + s] = n, v + 1
    for at, sign in ((classes[chosen], 1), (CLASSES + shapes[chosen], -1)):
        class_n += sign * np.bincount(at, counts[chosen], len(both))
        class_v += sign * np.bincount(at, minlength=len(both))
    alone = (both.sum(0) + 0.1) / (both.sum() + 0.1 * len(both))
    given = both / np.maximum(1, both.sum(1, keepdims=True))
    weight = bigram_weight(both) * (both.sum(1, keepdims=True) > 0)
    transitions = np.log10(weight * given + (1 - weight) * alone[None])
    return Model(keys, counts, classes, int(total.n), int(total.v), transitions, class_n, np.maximum(1, class_v))


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The places of keys, or -1."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


def score(docs: DataFrame, words: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity) of docs; a null text is empty and has its end only."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        unit = math.log10(m.n + 0.1 * (m.v + 1))
        per_class = np.log10(np.maximum(1e-300, m.class_n + ADDED * m.class_v))
        for b in batches:
            for i, j, w in chunks(b):
                hashes, shapes, first = tokens(w)
                keys = _keys(hashes, shapes)
                at = _find(m.keys, keys)
                known = at >= 0
                cls = np.where(known, m.classes[at] if len(m.classes) else 0, CLASSES + shapes)
                before = np.empty_like(cls)
                before[1:] = cls[:-1]
                before[first[:-1]] = CLASSES + _END_SHAPE
                counts = np.where(known, m.counts[at] if len(m.counts) else 0, 0)
                base = np.where(known, np.log10(counts + 0.1) - unit, 0.0)
                lm = m.transitions[before, cls] - per_class[cls] + np.where(known, np.log10(counts + ADDED), 0.0)
                row = np.repeat(np.arange(j - i), np.diff(first))
                uid = b.column("uid").slice(i, j - i).to_numpy()
                ids = b.column("key").slice(i, j - i).to_numpy()
                n = np.diff(first)
                yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array(ids), pa.array(-n.astype(np.int64)), pa.array(np.add.reduceat(known.astype(np.int64), first[:-1])), pa.array(np.add.reduceat(base, first[:-1])), pa.array(np.add.reduceat(lm, first[:-1]))], names=list("ukncbs"))
                rare = np.flatnonzero(~known)
                order = rare[np.lexsort((keys[rare], row[rare]))]
                if len(order):
                    new = np.flatnonzero(np.r_[True, (keys[order][1:] != keys[order][:-1]) | (row[order][1:] != row[order][:-1])])
                    times = np.diff(np.r_[new, len(order)])
                    who = order[new]
                    zero = np.zeros(len(who))
                    yield pa.RecordBatch.from_arrays([pa.array(uid[row[who]]), pa.array(keys[who].view(np.int64)), pa.array(times.astype(np.int64)), pa.array(zero.astype(np.int64)), pa.array(zero), pa.array(zero)], names=list("ukncbs"))

    none = -(1 << 63)
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.coalesce(F.col("doc_id").cast("long"), F.lit(none)).alias("key"), "text")
    parts = rows.mapInArrow(run, "u long, k long, n long, c long, b double, s double")
    seen = words.where(F.col("n") < max(1.0, LOOKED_UP * model.n)).select("key", F.col("n").alias("count"))
    parts = parts.join(seen, parts["k"] == seen["key"], "left")
    text, word = F.col("n") < 0, F.col("n") > 0
    each = F.log10(F.coalesce("count", F.lit(0)) + F.lit(0.1))
    unit = math.log10(model.n + 0.1 * (model.v + 1))
    scores = parts.groupBy("u").agg(
        F.max(F.when(text, F.col("k"))).alias("doc_id"),
        F.sum(F.when(text, -F.col("n"))).alias("n_tokens"),
        F.sum(F.when(text, F.col("c")).when(F.col("count").isNotNull(), F.col("n")).otherwise(0)).alias("n_known"),
        F.sum(F.when(word, F.col("n") * (each - F.lit(unit))).otherwise(F.col("b"))).alias("base_score"),
        F.sum(F.when(word, F.col("n") * each).otherwise(F.col("s"))).alias("score"),
    )
    return scores.select(F.when(F.col("doc_id") != none, F.col("doc_id")).alias("doc_id"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def class_scores(docs: DataFrame, training) -> DataFrame:
    """Scores of all docs (doc_id, text) by the model of those for which the column `training` is true.

    An empty table gives no rows; without training texts every token is unknown. Ids are whole numbers; a null id stays
    null, and each of repeated rows counts and is scored. Texts of any length are read whole; other columns are not read.
    """
    taught = docs.where(training)
    words = cut(count_words(taught))
    return score(docs, words, fit(taught, words))
