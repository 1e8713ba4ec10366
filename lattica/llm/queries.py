"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import read_table
from lattica.llm.lines import LINES_SQL
from lattica.llm.oracles import CHAT_SQL, DIVERGENCE_SQL, JACCARD_SQL, MANIFEST_SQL, REPEATS_SQL, VECTORS_SQL


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.repeats import remove_repeats

    return remove_repeats(read_table(spark, sf_dir, "documents"), text=False)


def op2_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.vectors import near_vectors

    return near_vectors(read_table(spark, sf_dir, "embeddings"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.mixing import mix_documents

    return mix_documents(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.lines import line_digests

    return line_digests(read_table(spark, sf_dir, "documents"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.chosen_path import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.fingerprints import edited_fingerprints

    return edited_fingerprints(read_table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lattica.llm.bpe import bpe_encode

    docs = read_table(spark, sf_dir, "documents")
    return bpe_encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ids=False)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.toxicity import THRESHOLD, fit, fold, score

    docs = read_table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.html import main_text

    return main_text(read_table(spark, sf_dir, "pages"))


def op8_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.brown import class_scores
    from lattica.llm.toxicity import fold

    scores = class_scores(read_table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 10) != 0)
    return scores.select("doc_id", (fold(F.col("doc_id"), 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.divergence import divergence

    return divergence(read_table(spark, sf_dir, "documents"))


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.chat import chat_digests

    more = spark.sql("select cast(-1 as bigint) as conv_id, cast(turn as bigint) as turn, role, '</s>[INST] ok [/INST]' as text from values (0, 'user'), (1, 'assistant') as t(turn, role)")
    return chat_digests(read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.manifest import manifest

    return manifest(read_table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 5 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_repeats": op1_repeats,
    "op2_vectors": op2_vectors,
    "op3_source_mix": op3_source_mix,
    "op4_main_text": op4_main_text,
    "op5_lines": op5_lines,
    "op6_jaccard": op6_jaccard,
    "op7_fingerprints": op7_fingerprints,
    "op8_class_lm": op8_class_lm,
    "op9_bpe": op9_bpe,
    "op10_toxicity": op10_toxicity,
    "op11_divergence": op11_divergence,
    "op12_chat": op12_chat,
    "op13_manifest": op13_manifest,
}

ORACLES: dict[str, str] = {
    "op1_repeats": REPEATS_SQL,
    "op2_vectors": VECTORS_SQL,
    "op5_lines": LINES_SQL,
    "op6_jaccard": JACCARD_SQL,
    "op11_divergence": DIVERGENCE_SQL,
    "op12_chat": CHAT_SQL,
    "op13_manifest": MANIFEST_SQL,
}
