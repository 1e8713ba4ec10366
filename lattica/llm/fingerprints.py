"""Document fingerprints by one-permutation MinHash, with DataFrame operations only.

Shingles of five words are hashed once; the top bits of a hash name its bin and each bin keeps its least hash. An empty
bin is filled from a full bin that a fixed random probe order of its own finds first (optimal densification). Of each
bin the low eight bits are stored, packed as hexadecimal; likeness corrects for bins that agree by chance.
"""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import hash_sample
from lattica.plans.lineage import cut

WORDS = 5
BINS = 128
#: Stored bits of each bin.
BITS = 8
#: Rows of a bucket of neighbouring ids, about, and buckets, at most; a key in so many is sampled to set their borders.
BUCKET, BUCKETS, SAMPLED = 1024, 10_000, 20
#: Probes of an empty bin before all full bins are ranked.
_PROBES = 24


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """Sorted 64-bit hashes of the word shingles of a text; a text of fewer words is one shingle, one without words has none."""
    tokens = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashed = F.transform(tokens, lambda w: F.xxhash64(w))
    # `let` by a one-element array: the arrays are computed once, not once for each shingle
    def of(h: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(h) - words), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(words)]))
        return F.when(F.size(h) >= words, many).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return F.sort_array(F.flatten(F.transform(F.array(hashed), of)))


def _bin(x: Column) -> Column:
    return F.shiftrightunsigned(x, 64 - (BINS - 1).bit_length()).cast("int")


def _let(value: Column, f) -> Column:
    return F.get(F.transform(F.array(value), f), 0)


def fingerprint(text: Column) -> Column:
    """The packed fingerprint of a text: 2 * BINS hexadecimal digits; '' for a null text or one without words. Equal texts have equal ones."""
    probes = random.Random(20_26)
    tables = [F.array(*[F.lit(probes.randrange(BINS)) for _ in range(BINS)]) for _ in range(_PROBES)]

    def pack(least: Column) -> Column:
        return _let(F.transform(least, _bin), lambda full: fill(least, full))

    def fill(least: Column, full: Column) -> Column:
        dense = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.get(least, F.array_position(full, b).cast("int") - 1))
        return _let(dense, lambda d: digits(d, full))

    def digits(d: Column, full: Column) -> Column:
        ranked = lambda b: F.get(d, F.array_min(F.transform(full, lambda f: F.struct(F.xxhash64(b, f), f.alias("f"))))["f"])
        filled = lambda b: F.coalesce(F.get(d, b), *[F.get(d, F.get(t, b)) for t in tables], ranked(b))
        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.substring(F.hex(F.xxhash64(filled(b)).bitwiseAND(255) + 256), 2, 2)), "")

    def least(s: Column) -> Column:
        return F.filter(s, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(s, i - 1))))

    # a hash's sign is its top bit, so sorted signed hashes stand bin by bin
    return _let(shingle_hashes(F.coalesce(text, F.lit(""))), lambda s: F.when(F.size(s) == 0, F.lit("")).otherwise(_let(least(s), pack)))


def likeness(a: Column, b: Column) -> Column:
    """The estimated Jaccard likeness, 0 to 1, of two fingerprints; two empty ones are alike, an empty and another aren't."""
    same = F.size(F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.substring(a, i * 2 + 1, F.lit(2)) == F.substring(b, i * 2 + 1, F.lit(2))))
    chance = 2.0**-BITS
    estimate = (same / F.lit(float(BINS)) - chance) / (1 - chance)
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), estimate))


def _borders(keys: DataFrame, buckets: int, n: int) -> DataFrame:
    """One row (one, coarse, fine): sorted keys that part the n keys (_key) into about so many equal buckets, in two levels."""
    sample = hash_sample(keys, F.xxhash64("_key"), SAMPLED * buckets, n).agg(F.sort_array(F.collect_list("_key")).alias("s"))
    side = max(1, round(buckets**0.5))
    step = F.greatest(F.lit(1), F.floor(F.size("s") / buckets))
    borders = sample.select(F.filter("s", lambda x, i: i % step == 0).alias("s"))
    coarse = borders.select("s", F.filter("s", lambda x, i: i % side == 0).alias("coarse"))
    return cut(coarse.select(F.lit(1).alias("_one"), "coarse", F.transform("coarse", lambda x, i: F.slice(F.col("s"), i * side + 1, F.lit(side))).alias("fine"), F.lit(side).alias("side")))


def with_next(docs: DataFrame, more: Callable[[DataFrame], DataFrame], columns: list[str], bucket: int = BUCKET) -> DataFrame:
    """docs (doc_id, text) with what `more` adds and next_<c>: column c of the next row in descending doc_id, and for the last the first row's.

    Rows are dealt by ranges of (doc_id, hash of text) that a sample parts evenly, whatever the ids' type and spread, so no
    task orders the whole table: each range also gets the last row of the range before it. Rows of equal ids are in
    descending order of their texts' hashes; of equal rows all but one are followed by a copy. A null id is less than all others.
    """
    docs = docs.withColumn("_key", F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h")))
    n = docs.count()
    buckets = max(1, min(BUCKETS, n // bucket))
    borders = F.broadcast(_borders(docs.select("_key"), buckets, n))  # one row of at most BUCKETS keys
    above = lambda keys: F.size(F.filter(keys, lambda x: x <= F.col("_key")))
    dealt = docs.withColumn("_one", F.lit(1)).join(borders, "_one").withColumn("_c", above(F.col("coarse")))
    dealt = dealt.withColumn("_bucket", F.when(F.col("_c") == 0, 0).otherwise((F.col("_c") - 1) * F.col("side") + above(F.get("fine", F.col("_c") - 1))))
    dealt = dealt.select("doc_id", "text", "_key", "_bucket")
    heads = cut(dealt.groupBy("_bucket").agg(F.max("_key").alias("_head")))
    everything = Window.orderBy("_bucket")  # BUCKETS rows at most
    follows = heads.select("_bucket", F.coalesce(F.lag("_head").over(everything), F.max("_head").over(Window.partitionBy())).alias("_head"))
    guests = docs.join(F.broadcast(follows), docs["_key"] == F.col("_head")).groupBy("_bucket").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.first("_key").alias("_key"))
    rows = more(dealt.withColumn("_sort", F.lit(1))).unionByName(more(guests.withColumn("_sort", F.lit(0))))
    w = Window.partitionBy("_bucket").orderBy("_sort", "_key")
    return rows.select("*", *[F.lag(c).over(w).alias(f"next_{c}") for c in columns]).where("_sort = 1").drop("_bucket", "_sort", "_key")


def edited(text: Column, following: Column) -> Column:
    """text with its last floor(n / 3) code points replaced by as many first ones of the following text (or all it has)."""
    k = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - k), F.substring(following, F.lit(1), k))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of docs (doc_id, text).

    See `with_next`, `edited`, `fingerprint` and `likeness` for ties, null ids and repeated rows. A null text is empty, texts
    of any length are read whole, an empty table gives an empty one, and other columns are not read.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(texts, lambda df: df.withColumn("fingerprint", fingerprint(F.col("text"))), ["text", "fingerprint"])
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), "fingerprint", "next_fingerprint", edited(F.col("text"), F.col("next_text")).alias("_edited"))
    rows = rows.withColumn("edited_fingerprint", fingerprint(F.col("_edited")))
    return rows.select("doc_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
