"""The corpus pipeline: from documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Rows are documents of their own to the near-duplicate stage, whether or not they share a doc_id or have none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import toxicity
from lattica.llm.bpe import bpe_encode
from lattica.llm.chosen_path import similar
from lattica.llm.common import read_table, row_key
from lattica.llm.lines import deduplicated
from lattica.llm.mixing import mixed_documents
from lattica.plans.lineage import cut

RANKS = "byte_bpe_multi_50k.tiktoken"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose toxicity score is below the threshold, by a model of these rows and the labels of two folds of three."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the runs of lines that occur earlier; n_chars is that of the new text.

    Earlier is a smaller doc_id (null last), of equal ids a smaller hash of the text. Null and empty texts stay what they
    are, an empty table stays empty, and repeated rows are all kept, with equal texts.
    """
    return deduplicated(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that of the smallest doc_id; rows without words are in no group and stay.

    Of a group's rows that share the smallest doc_id one stays, by a hash; a null doc_id counts as larger than all others.
    """
    # the number of a row tells equal rows apart; it is written, so that all readers have the same
    name = "_row" + "_" * max(map(len, docs.columns))  # no column of docs has so long a name
    rows = cut(docs.withColumn(name, F.struct(row_key("doc_id", "text").alias("key"), F.monotonically_increasing_id().alias("n"))))
    kept = similar(rows.select(F.col(name).alias("d"), "text")).where("d = class_id").select("d")
    return rows.join(kept, rows[name] == kept["d"], "left_semi").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources at their target weights; a row of a second epoch is a row again.

    The order is by hashes of doc_id, number of words and text, so that rows that share an id, or have none, are mixed
    alike in every run. Null sources are one source; null and empty texts, without words, are in no epoch. An empty table
    stays empty.
    """
    return mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids): the token ids of each text and the digest of their decoding.

    One row for each row, whatever ids or texts repeat. A null or empty text has no tokens; texts of any length are
    encoded whole, and an empty table gives an empty one.
    """
    import public_tokenizers

    return bpe_encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing", mix_sources),
    ("byte-level BPE", encode),
]

#: Toxicity scores, chosen paths and merges by rank have no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written before the next one reads them."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
