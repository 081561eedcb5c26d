"""Structured Streaming forms: incremental upserts from a file stream, windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import store
from ..operators.settle import holding, settled
from ..sources.snapshot import Snapshots


def upsert_stream(spark: SparkSession, source: str, schema: str, tables: Snapshots, checkpoint: str):
    """Takes what is new below source (Parquet of nodes) into the nodes table, each batch once; returns the query."""

    def take(batch: DataFrame, _: int) -> None:
        # of the rows of an id the one in the latest file; within a file, ties go to the larger content
        row = F.struct("modified", "path", "content", "hash", "type")
        latest = batch.groupBy("id").agg(F.max(row).alias("row")).select("id", "row.type", "row.content", "row.hash")
        def upsert() -> None:
            states = store.diff(tables.table("nodes").select("id", "hash"), latest.select("id", "hash")).filter("state in ('new', 'changed')").select("id")
            delta = settled(latest.join(states, "id", "left_semi"))
            if not delta.isEmpty():
                tables.commit({"nodes": (delta, delta.select("id"))})

        with holding():
            tables.attempt(upsert)
        tables.merge()

    stream = spark.readStream.schema(schema).parquet(source).select("*", F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_path").alias("path"))
    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type; with a stream, rows later than `late` are dropped once their window closed."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
