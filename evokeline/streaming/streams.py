"""Streaming twins: power in tumbling windows, rejection by range, and sessions of high values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_tumbling_power(stream_df: DataFrame, watermark: str = "30 seconds", size: str = "10 seconds") -> DataFrame:
    """(subject, start, power, n): the mean square of each window."""
    g = stream_df.withWatermark("ts", watermark).groupBy(F.window("ts", size).alias("w"), "subject")
    return g.agg(F.avg(F.col("value") * F.col("value")).alias("power"), F.count(F.lit(1)).alias("n")).select("subject", F.col("w.start").alias("start"), "power", "n")


def stream_reject_ptp(stream_df: DataFrame, limit: float, watermark: str = "30 seconds", size: str = "10 seconds") -> DataFrame:
    """(subject, start, ptp, n) of windows whose range is within the limit."""
    g = stream_df.withWatermark("ts", watermark).groupBy(F.window("ts", size).alias("w"), "subject")
    ranges = g.agg((F.max("value") - F.min("value")).alias("ptp"), F.count(F.lit(1)).alias("n"))
    return ranges.where(F.col("ptp") <= limit).select("subject", F.col("w.start").alias("start"), "ptp", "n")


def stream_blink_sessions(stream_df: DataFrame, threshold: float, watermark: str = "30 seconds", gap: str = "10 seconds") -> DataFrame:
    """(subject, start, n, peak) of runs of rows over the threshold with less than ``gap`` between them."""
    high = stream_df.where(F.col("value") > threshold).withWatermark("ts", watermark)  # time goes on with these rows
    g = high.groupBy(F.session_window("ts", gap).alias("w"), "subject").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("peak"))
    return g.select("subject", F.col("w.start").alias("start"), "n", "peak")


def finished(stream_df: DataFrame, path: str) -> DataFrame:
    """The rows that a stream appends when it has read all that is there; written as Parquet below ``path``."""
    run = stream_df.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).outputMode("append").start()
    run.awaitTermination()
    return stream_df.sparkSession.read.schema(stream_df.schema).parquet(f"{path}/rows")
