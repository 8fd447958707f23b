"""Structured Streaming: windows over event streams, and a graph kept by micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.model import Graph
from graphloom.operators.write import merge_nodes


def windowed_counts(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(window_start, event_type, n, total) over (ts, event_type, value); works on streams and tables alike."""
    at = F.col("ts").cast("timestamp")
    rows = events.withColumn("at", at)
    rows = rows.withWatermark("at", late) if events.isStreaming else rows
    return rows.groupBy(F.window("at", size, slide), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, session_start, session_end, n) over (user_id, ts)."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("at", late) if events.isStreaming else rows
    return rows.groupBy("user_id", F.session_window("at", gap)).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def keep_graph(rows: DataFrame, path: str, start: Graph, key: Column, checkpoint: str) -> StreamingQuery:
    """Upsert a stream of (label, merge_key, props, seq) into a node table at ``path``, a version per micro-batch.

    Each batch reads the version before it and writes its own, so a batch that runs again after a failure gives the same table.
    """
    spark = rows.sparkSession

    def version(n: int) -> DataFrame:
        return spark.read.schema(start.nodes.schema).parquet(f"{path}/v{n}") if n >= 0 else start.nodes

    def apply(batch: DataFrame, n: int) -> None:
        merged, _ = merge_nodes(Graph(version(n - 1), start.edges), batch, key)
        merged.nodes.write.mode("overwrite").parquet(f"{path}/v{n}")

    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).start()


def each_batch(rows: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).start()
