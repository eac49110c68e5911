"""Streaming ingest: idempotent appends of a document stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vecspark.operators import embedding


def embedded(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A stream (doc_id, text, ts) embedded, each id once within the watermark."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["doc_id"]).withColumn("vector", embedding.hashed(F.col("text")))


def ingest(stream: DataFrame, target: str, checkpoint: str, delay: str = "1 hour", once: bool = True) -> StreamingQuery:
    """Append new documents to Parquet at `target`; the checkpoint makes a restart exact."""
    writer = embedded(stream, delay).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", target)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(stream: DataFrame, width: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Events (ts, event_type) a window, late ones within the watermark included."""
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))
