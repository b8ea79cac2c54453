"""Event-time aggregation of the events table as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and their sum of values for each window and type; works on streams and on tables."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", late)
    out = timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def stream(spark: SparkSession, folder: str) -> DataFrame:
    """The Parquet files of a folder as a stream, with the schema of those there now."""
    return spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
