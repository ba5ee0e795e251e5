"""Telemetry events as a stream: counts in event-time windows, with late events up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def on_time(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events with a watermark: what comes later than that after newer events may be left out."""
    return events.withWatermark("ts", late)


def windowed_actions(events: DataFrame, window: str = "1 day") -> DataFrame:
    """Number and mean duration of each action in each window; works on streams (on_time) and on tables."""
    grouped = events.groupBy(F.window("ts", window), F.col("event_type").alias("action"))
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_ms")).select(F.col("window.start").alias("start"), "action", "n", "mean_ms")


def distinct_events(events: DataFrame) -> DataFrame:
    """Events of a stream (on_time) without repeats of an event_id within the watermark."""
    return events.dropDuplicatesWithinWatermark(["event_id"])
