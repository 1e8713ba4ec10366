"""Incremental ingestion into a graph, and windowed metrics of an event stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lattica.operators.graph import merge_edges, merge_nodes
from lattica.plans.lineage import cut


def merge_stream(stream: DataFrame, nodes_path: str, edges_path: str, checkpoint: str, trigger_once: bool = True) -> StreamingQuery:
    """Merges a stream of edges (src, type, dst) and the nodes they name into two Parquet tables, batch by batch.

    A batch that is run again changes nothing, since merging is by key.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        edges = cut(batch.select("src", "type", "dst"))
        new = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct().withColumn("ord", F.lit(number))

        def known(path: str, schema: str) -> DataFrame:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
            return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)

        nodes = known(nodes_path, "id string")
        merge_nodes(nodes, new, ["id"], "ord").join(nodes, "id", "left_anti").write.mode("append").parquet(nodes_path)
        before = known(edges_path, "src string, type string, dst string")
        merge_edges(before, edges).join(before, ["src", "type", "dst"], "left_anti").write.mode("append").parquet(edges_path)

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if trigger_once else writer).start()


def windowed_counts(events: DataFrame, time: str = "ts", keys: Sequence[str] = ("event_type",), width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and mean values in time windows; on a stream, rows later than the watermark are left out."""
    if events.isStreaming:
        events = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return events.groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), *keys, "n", "mean")


def stream_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)
