"""Test sets over relations: chunks linked by what they share, groups of linked chunks for questions that need several, and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica import providers
from lattica.operators.vector_index import VectorIndex
from lattica.plans.lineage import cut
from lattica.session import ship

#: Chunks of one keyphrase that are put in order together.
SHARD = 10_000


def shared_links(chunks: DataFrame, phrases: DataFrame, least: int = 2, fan: int = 3, seed: int = 11) -> DataFrame:
    """(a, b, shared) with a < b: chunks (id) that share at least `least` of their keyphrases (id, term), and how many.

    It is a sample that grows with the chunks and not with their pairs: the chunks of a keyphrase are put in an order by
    a seeded hash, and each is paired with the `fan` next ones. A keyphrase of many chunks is dealt into shards first.
    """
    terms = cut(phrases.join(chunks.select("id").distinct(), "id", "left_semi").select("id", "term").distinct())
    sets = terms.groupBy("id").agg(F.array_sort(F.collect_list("term")).alias("terms"))
    shards = terms.groupBy("term").agg(F.ceil(F.count("*") / SHARD).alias("shards"))
    order = F.xxhash64("id", "term", F.lit(seed))
    dealt = terms.join(shards, "term").select("id", "term", order.alias("o"), F.pmod(order, "shards").alias("shard"))
    w = Window.partitionBy("term", "shard").orderBy("o", "id")
    nexts = dealt.select("id", *[F.lead("id", i).over(w).alias(f"n{i}") for i in range(1, fan + 1)])
    met = nexts.select("id", F.explode(F.array_compact(F.array(*[f"n{i}" for i in range(1, fan + 1)]))).alias("other"))
    met = met.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    both = met.join(sets.withColumnsRenamed({"id": "a", "terms": "x"}), "a").join(sets.withColumnsRenamed({"id": "b", "terms": "y"}), "b")
    return both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("shared")).where(F.col("shared") >= least)


def similar_links(vectors: DataFrame, least: float = 0.8, fan: int = 3) -> DataFrame:
    """(a, b, score) with a < b: chunks (item_id, vec of length one) among each other's `fan` nearest, from a cosine of `least` on."""
    near = VectorIndex.build(vectors).search(vectors.withColumnRenamed("item_id", "query_id"), fan + 1, exact=True).where("query_id <> item_id").where(F.col("score") >= least)
    return near.select(F.least("query_id", "item_id").alias("a"), F.greatest("query_id", "item_id").alias("b"), "score").distinct()


def multi_hop_groups(links: DataFrame, per_context: int = 2, seed: int = 11) -> DataFrame:
    """links (a, b, ...) such that every chunk is in at most `per_context` of them.

    Links are in an order by a seeded hash; one stays if it is among the first of both its ends.
    """
    numbered = cut(links.withColumn("_o", F.xxhash64("a", "b", F.lit(seed))))
    ends = numbered.select("a", "b", "_o", F.explode(F.array(F.col("a"), F.col("b"))).alias("end"))
    first = ends.withColumn("_n", F.row_number().over(Window.partitionBy("end").orderBy("_o", "a", "b"))).where(F.col("_n") <= per_context)
    stay = first.groupBy("a", "b").agg(F.count("*").alias("_ends")).where("_ends = 2").select("a", "b")
    return numbered.join(stay, ["a", "b"], "left_semi").drop("_o")


def question_set(chunks: DataFrame, groups: DataFrame, writer: providers.Provider, critic: providers.Provider | None = None, passing: float = 5.0, per_context: int = 2, style: str = "", size: int | None = None, seed: int = 11) -> DataFrame:
    """(hops, contexts, input, expected_output): questions about single chunks (id, text) and about groups (a, b) of two.

    A context gives at most `per_context` questions by itself, and is in the groups that are given. critic: a judge that
    replies in JSON, whose score of correctness must reach `passing`; a reply that can't be read fails. size: how many
    questions there are at most, the first in an order by a seeded hash; all without it.
    """
    from lattica.functions.metrics import parse_judge

    ship(chunks.sparkSession)
    text = chunks.select("id", "text")
    one = text.select(F.lit(1).alias("hops"), F.array(F.col("id").cast("string")).alias("contexts"), "text")
    two = groups.select("a", "b").join(text.withColumnsRenamed({"id": "a", "text": "x"}), "a").join(text.withColumnsRenamed({"id": "b", "text": "y"}), "b")
    two = two.select(F.lit(2).alias("hops"), F.array(F.col("a").cast("string"), F.col("b").cast("string")).alias("contexts"), F.concat_ws(" ", "x", "y").alias("text"))
    said = cut(one.unionByName(two).withColumn("reply", providers.column(writer)(F.concat(F.lit(style), "text"))))
    schema = "struct<qa: array<struct<question: string, answer: string>>>"
    rows = said.select("hops", "contexts", "text", F.posexplode(F.from_json("reply", schema)["qa"]).alias("pos", "q")).where(F.col("pos") < per_context)
    rows = rows.select("hops", "contexts", "text", F.col("q.question").alias("input"), F.col("q.answer").alias("expected_output")).where("input <> ''")
    if critic is not None:
        asked = F.to_json(F.struct(F.col("input").alias("question"), F.col("text").alias("truth"), F.col("expected_output").alias("answer"), F.array("text").alias("contexts")))
        rows = cut(rows.withColumn("verdict", parse_judge(providers.column(critic)(asked)))).where(F.coalesce(F.col("verdict.answer_correctness_score"), F.lit(0.0)) >= passing)
    rows = rows.select("hops", "contexts", "input", "expected_output")
    return rows if size is None else rows.orderBy(F.xxhash64("contexts", "input", F.lit(seed)), "contexts", "input").limit(size)


def split_of(key: Column, train: float = 0.8, test: float = 0.1, seed: int = 11) -> Column:
    """'train', 'test' or 'validation' by a seeded hash of a key, so that equal keys are in one split."""
    at = F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 32) / F.lit(float(2**32))
    return F.when(at < train, "train").when(at < train + test, "test").otherwise("validation")
