"""Streams of facts and events: what the incremental scan does for folders, done for rows as they come.

Each function takes a batch or a stream: the plan is the same, and a test can hold the stream against it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def source(spark: SparkSession, path: str, schema, files_per_batch: int = 16) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _timed(events: DataFrame, late: str) -> DataFrame:
    """With a watermark; times without a zone are taken for UTC instants, as streams need."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums by type and window of event time."""
    sums = _timed(events, late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return sums.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 days", step: str = "1 day", late: str = "1 hour") -> DataFrame:
    sums = _timed(events, late).groupBy(F.window("ts", width, step).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return sums.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "12 hours", late: str = "1 hour") -> DataFrame:
    """A row for each run of a user's events with no gap: its first event, the end of its last gap, its length."""
    sums = _timed(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return sums.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_of_each(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """Rows without replays of their keys; a stream forgets keys once they are later than the watermark."""
    marked = _timed(events, late)
    return marked.dropDuplicatesWithinWatermark(keys) if events.isStreaming else marked.dropDuplicates(keys)


def upserts(stream: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None]):
    """Runs what has come so far, batch by batch; apply(batch, number) must give the same table if a batch comes again."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
