"""Mixing sources to target weights, with DataFrame operations only.

Rows get hash-random keys. Within a source they are ordered by key: the key's range is divided into equal buckets, the
buckets' word counts are summed and prefix-summed for each source, and a prefix sum inside each bucket completes the
order. So a source that holds a third of all rows is spread over its buckets. Each source is then cut at its budget:
whole epochs first, then the rows before the cut, the row at the cut in part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import WORD
from lattica.plans.lineage import cut

#: Weights of the sources in code point order, repeating.
CYCLE = (3.0, 1.0, 2.0)
#: Buckets that the hash keys of each source are divided into.
BUCKETS = 1024


def n_words(text: Column) -> Column:
    """Words of a text; 0 for a null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cycle_weights(sources: DataFrame, cycle: tuple[float, ...] = CYCLE) -> DataFrame:
    """sources with a column weight: cycle in code point order of source, null last, repeating. One row for each source."""
    at = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    return sources.withColumn("weight", F.get(weights, at % len(cycle)))


def water_fill(sources: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sources (source, source_size, weight) with target: share of all sizes dealt by weight, at most `most` times a source's size.

    What a source can't take is dealt again by weight until none is above its limit. That fixed point is
    min(limit, level * weight) with one level for all, found by prefix sums in the order of limit / weight.
    """
    full = F.col("source_size") * F.lit(float(most))
    upto = Window.orderBy(F.col("ratio"), F.col("source").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    s = sources.withColumn("full", full).withColumn("ratio", full / F.col("weight"))
    s = s.withColumns({
        "budget": F.sum("source_size").over(everything) * F.lit(float(share)),
        "all_weight": F.sum("weight").over(everything),
        "full_before": F.coalesce(F.sum("full").over(upto), F.lit(0.0)),
        "weight_before": F.coalesce(F.sum("weight").over(upto), F.lit(0.0)),
    })
    level = (F.col("budget") - F.col("full_before")) / (F.col("all_weight") - F.col("weight_before"))
    s = s.withColumn("level", level)
    # in this order levels rise while a source can't take its share, and fall after the first that can
    s = s.withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything))
    return s.select("source", "source_size", "weight", F.least("full", F.coalesce(F.col("level") * F.col("weight"), F.col("full"))).alias("target"))


def mix(sized: DataFrame, weights=cycle_weights, share: float = 1.5, most: float = 2.0, seed: int = 0, buckets: int = BUCKETS, tie: str | None = None) -> DataFrame:
    """sized (doc_id, source, size, and any more columns) with source_size, target and taken.

    weights: adds a column weight to a table of sources. taken counts the words that the mix takes of a row, repeats
    counted: size times the whole epochs of its source, and in the last epoch size, a part of it, or 0. Sources' sums
    of taken are their targets, rounded down. Sizes of 0 take 0; a null source is a source like the others; equal rows
    take as many words as their places in the order give, in any order among themselves. Column names of sized stay, but for `tie`, a
    column that tells rows of one doc_id (or none) and size apart.
    """
    more = [tie] if tie else []
    order = F.xxhash64(F.col("doc_id"), F.lit(seed), F.col("size"), *more)
    keyed = sized.withColumn("_key", order).withColumn("_bucket", F.shiftrightunsigned(F.col("_key"), 64 - (buckets - 1).bit_length()).cast("int"))
    parts = keyed.groupBy("source", "_bucket").agg(F.sum("size").alias("_words"))
    sources = water_fill(weights(parts.groupBy("source").agg(F.sum("_words").alias("source_size"))), share, most)
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(F.col("source").alias("_s"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_start"))
    starts = starts.join(sources.withColumnRenamed("source", "_s2"), F.col("_s").eqNullSafe(F.col("_s2")))
    rows = keyed.join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    inside = Window.partitionBy("source", "_bucket").orderBy("_key", "doc_id", "size", *more).rowsBetween(Window.unboundedPreceding, -1)
    place = F.col("_start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    epochs = F.coalesce(F.try_divide(F.floor("target"), F.col("source_size")).cast("long"), F.lit(0))
    rest = F.floor("target").cast("long") - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - place))
    return rows.withColumn("taken", taken.cast("long")).select(*[c for c in sized.columns if c != tie], "source_size", "target", "taken")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of docs (doc_id, source, text); sizes are computed once."""
    return mix(cut(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("_tie"))), tie="_tie", **options)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of docs once for each whole epoch of its source, and the row at the cut with its first words only.

    A text without words is in no epoch. Columns and their names stay those of docs; only the text of a row at a cut is
    shorter (and n_chars, if docs has it, is the length of what is left).
    """
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("_tie"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = mix(sized, tie="_tie", **options)
    takes = F.transform(F.sequence(F.lit(1), F.ceil(F.try_divide("taken", "size")).cast("int")), lambda i: F.least(F.col("size"), F.col("taken") - (i - 1) * F.col("size")))
    rows = rows.where("taken > 0").select("row", "size", F.explode(takes).alias("words"))
    first = F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), F.lit(1), F.col("words").cast("int")), "")
    rows = rows.withColumn("text", F.when(F.col("words") < F.col("size"), first).otherwise(F.col("row.text")))
    kept = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return rows.select(*[(kept[c] if c in kept else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
