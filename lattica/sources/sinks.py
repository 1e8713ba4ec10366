"""Writers: question and evaluation tables as CSV, graphs as Parquet, and runs as folders."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators.graph import PropertyGraph

# The column orders of the two tables.
QA_COLUMNS = ("question_type", "source", "question", "answer", "persona", "task", "chunk_id", "chunk", "file_path", "retrieved_contexts")
EVALUATION_COLUMNS = (
    "question", "ground_truth_answer", "rag_answer", "retrieved_contexts", "answer_correctness_score", "answer_correctness_reason",
    "context_relevance_score", "context_relevance_reason", "latency_ms", "prompt_tokens", "completion_tokens", "total_tokens",
    "question_type", "source", "persona", "task", "chunk_id",
)


def _flat(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    contexts = F.to_json(F.coalesce("retrieved_contexts", F.array().cast("array<string>")))
    return df.select(*[contexts.alias(c) if c == "retrieved_contexts" else F.col(c) for c in columns])


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_qa(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Ten columns in their order; contexts as JSON, none for null."""
    write_csv(_flat(df, QA_COLUMNS), path, mode)


def write_evaluation(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Seventeen columns in their order; contexts as JSON, none for null."""
    write_csv(_flat(df, EVALUATION_COLUMNS), path, mode)


def write_experiment(df: DataFrame, folder: str, prefix: str, run_id: str) -> str:
    """Writes an experiment's rows as CSV, arrays and structs as JSON, under a prefix and its run's id; a run that is there already is an error. The path."""
    path = f"{folder.rstrip('/')}/{prefix}{run_id}"
    flat = [F.to_json(c).alias(c) if kind.startswith(("array", "struct", "map")) else F.col(c) for c, kind in df.dtypes]
    write_csv(df.select(*flat), path)
    return path


def write_graph(graph: PropertyGraph, path: str, mode: str = "errorifexists", quarantine: DataFrame | None = None) -> None:
    """nodes, and edges in a folder for each type, so that a scan of one type reads only that; and the replies that couldn't be read."""
    if quarantine is not None:
        quarantine.write.mode(mode).parquet(f"{path}/quarantine")
    graph.nodes.write.mode(mode).parquet(f"{path}/nodes")
    graph.edges.write.mode(mode).partitionBy("type").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> PropertyGraph:
    return PropertyGraph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))


class Run:
    """A folder that keeps a run's parameters, metrics and tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _save(self, kind: str, values: dict) -> None:
        rows = [(str(k), json.dumps(v, default=str)) for k, v in values.items()]
        self.spark.createDataFrame(rows, "name string, value string").coalesce(1).write.mode("append").json(f"{self.folder}/{kind}")

    def log_parameters(self, values: dict) -> None:
        self._save("params", values)

    def log_metrics(self, values: dict) -> None:
        self._save("metrics", values)

    def log_table(self, name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/tables/{name}")

    def end(self) -> None:
        self._save("state", {"ended": True})
