"""Cutting the lineage of iterative plans through the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows that a partition of a spread table aims at.
SPREAD = 250_000


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder in spark.checkpoint.dir, which all executors share.

    Without that setting it is in a temporary folder, in local mode only: elsewhere executors wouldn't share it.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lattica-checkpoint-"))
        folder = sc.getCheckpointDir()
    return f"{folder.rstrip('/')}/lattica-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, **options: str | int) -> DataFrame:
    """df computed once and written as a table into the shared folder (see `shared_path`).

    Readers don't depend on the executors that computed it. Like Spark's own checkpoints by default, the files stay
    until the folder is cleaned. options: of the Parquet writer.
    """
    path = shared_path(df.sparkSession, "table")
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(df: DataFrame) -> int:
    """How many partitions the rows of a stored table call for: one for each core, more for a large table.

    Shuffles of a fixed number of partitions give tasks that grow with the input; these don't.
    """
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // SPREAD))


def spread(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """df dealt by keys into n partitions that are kept sorted, so that rounds of joins on the keys move the other side only.

    The caller unpersists it.
    """
    return df.repartition(n, *keys).sortWithinPartitions(*keys).persist()
