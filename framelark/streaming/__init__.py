"""Extensions for streams of events; nothing here is part of the batch inventory. Every function takes a stream or a table with ``ts`` and ``user_id``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_counts(events: DataFrame, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Events and mean value of each kind in windows of event time; events later than ``lateness`` behind the newest are left out of a stream."""
    kept = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    out = kept.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "mean")


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Runs of a user's events with less than ``gap`` between them: the event-time form of merged frame runs."""
    kept = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    out = kept.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
