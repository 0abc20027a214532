"""Structured Streaming: windowed counts, sessions, and scans of newly arrived submissions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import half_up


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def watermarked(events: DataFrame, late: str) -> DataFrame:
    """A stream forgets what is later than so long; a batch needs no watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def window_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and their value by tumbling window and type; a stream gets a watermark, a batch gives the same rows."""
    rows = watermarked(events, late)
    out = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "cents")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user: runs of events less than the gap apart."""
    rows = watermarked(events, late)
    out = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def type_stats(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), half_up(F.avg("value"), 2).alias("mean_value"))


def scan_arrivals(arrivals: DataFrame, scan: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Run a scan on each micro-batch of new submissions (it joins them to the history itself)."""
    writer = arrivals.writeStream.foreachBatch(scan).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
