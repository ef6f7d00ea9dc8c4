"""Runs, segments and windows of frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_frame():
    return Window.partitionBy("entity").orderBy("frame")


def islands(frames: DataFrame, gap: int = 0) -> DataFrame:
    """Runs of frames (entity, start, end, n); runs with at most ``gap`` missing frames between them are one."""
    new = F.coalesce(F.col("frame") - F.lag("frame").over(by_frame()) > gap + 1, F.lit(True)).cast("int")
    return frames.withColumn("_new", new).withColumn("_run", F.sum("_new").over(by_frame())).groupBy("entity", "_run").agg(F.min("frame").alias("start"), F.max("frame").alias("end"), F.count(F.lit(1)).alias("n")).drop("_run")


def top_runs(runs: DataFrame, k: int) -> DataFrame:
    """The ``k`` longest runs of each entity; of equal ones the later."""
    order = Window.partitionBy("entity").orderBy(F.col("n").desc(), F.col("start").desc())
    return runs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def merge_segments(segments: DataFrame) -> DataFrame:
    """Closed segments (entity, start, end) that overlap or touch as one."""
    order = Window.partitionBy("entity").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col("start") > reach + 1, F.lit(True)).cast("int")
    return segments.withColumn("_new", new).withColumn("_id", F.sum("_new").over(order)).groupBy("entity", "_id").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_id")


def best_window(series: DataFrame, name: str, share: float) -> DataFrame:
    """Per entity the first window of round(share * n) frames (1 at least) with the largest sum: start, length, total."""
    whole = Window.partitionBy("entity")
    rows = series.withColumn("_i", F.row_number().over(by_frame())).withColumn("_n", F.count(F.lit(1)).over(whole))
    rows = rows.withColumn("_len", F.greatest(F.lit(1), F.rint(share * F.col("_n"))).cast("int")).withColumn("_sum", F.sum(name).over(by_frame()))
    later = rows.select("entity", F.col("_i").alias("_j"), F.col("_sum").alias("_end"))
    ends = rows.withColumn("_j", F.col("_i") + F.col("_len") - 1).join(later, ["entity", "_j"])
    total = F.round(F.col("_end") - F.col("_sum") + F.col(name), 6)
    order = Window.partitionBy("entity").orderBy(F.col("total").desc(), "frame")
    return ends.withColumn("total", total).withColumn("_p", F.row_number().over(order)).where("_p = 1").select("entity", F.col("frame").alias("start"), F.col("_len").alias("length"), "total")


def top_fraction(series: DataFrame, name: str, share: float) -> DataFrame:
    """The round(share * n) frames (1 at least) with the largest values; ties: earlier."""
    order = Window.partitionBy("entity").orderBy(F.col(name).desc(), "frame")
    n = F.count(F.lit(1)).over(Window.partitionBy("entity"))
    return series.withColumn("_p", F.row_number().over(order)).withColumn("_k", F.greatest(F.lit(1), F.rint(share * n))).where("_p <= _k").drop("_p", "_k")
