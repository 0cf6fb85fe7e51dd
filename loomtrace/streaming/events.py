"""Structured Streaming over event rows: windows, sessions and de-duplication with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LATE = "1 hour"


def tumbling(events: DataFrame, width: str = "1 day", late: str = LATE) -> DataFrame:
    """Events and error rate per window; works on a batch and, with a watermark, on a stream."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    g = e.groupBy(F.window("ts", width)).agg(F.count("*").alias("n"), F.avg((F.col("event_type") == "error").cast("int")).alias("rate"))
    return g.select(F.col("window.start").alias("start"), "n", F.round("rate", 6).alias("rate"))


def sessions(events: DataFrame, gap: str = "6 hours", late: str = LATE) -> DataFrame:
    """Sessions of each user, closed by an inactivity gap."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    g = e.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def once(events: DataFrame, late: str = LATE) -> DataFrame:
    """Each event_id once within the watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there and stop; the checkpoint folder lets a later run go on from there."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
