"""Many detections a frame into one estimate, gates, overlays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pool_frames(dets: DataFrame, power: float = 1.0) -> DataFrame:
    """Per entity and frame: centre weighted by conf * area^power, held in 0..1, and the number of detections."""
    weight = F.col("conf") * F.pow("area", F.lit(power))
    out = dets.groupBy("entity", "frame").agg(F.sum(weight * F.col("c")).alias("s"), F.sum(weight).alias("w"), F.count(F.lit(1)).alias("n"))
    return out.where("w > 0").select("entity", "frame", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("s") / F.col("w"))).alias("center"), "n")


def pick_frames(dets: DataFrame, by: list) -> DataFrame:
    """The first detection of each frame by ``by``."""
    return dets.withColumn("_n", F.row_number().over(Window.partitionBy("entity", "frame").orderBy(*by))).where("_n = 1").drop("_n")


def entity_centers(pooled: DataFrame) -> DataFrame:
    """Per entity: median of the frame centres, clutter (mean detections a frame with any) and the share of frames with one."""
    return pooled.groupBy("entity").agg(F.percentile("center", F.lit(0.5)).alias("median"), F.avg("n").alias("clutter"), F.avg((F.col("n") == 1).cast("int")).alias("single"))


def gate(centers: DataFrame, entities: DataFrame, threshold: float) -> DataFrame:
    """Per row of ``entities``: the entity's centre, or 0.5 where there is none or it is too cluttered (``fallback``)."""
    joined = entities.select("entity").join(centers, "entity", "left")
    fallback = F.col("median").isNull() | (F.col("clutter") > threshold)
    return joined.select("entity", F.when(fallback, 0.5).otherwise(F.col("median")).alias("center"), fallback.alias("fallback"))


def overlay(base: DataFrame, patch: DataFrame, key: str, value: str) -> DataFrame:
    """``base`` with ``value`` replaced where ``patch`` has the key."""
    return base.join(patch.select(key, F.col(value).alias("_new"), F.lit(True).alias("patched")), key, "left").withColumn(value, F.when(F.col("patched"), F.col("_new")).otherwise(F.col(value))).withColumn("patched", F.coalesce("patched", F.lit(False))).drop("_new")


def clutter(samples: DataFrame, dets: DataFrame) -> DataFrame:
    """Per entity of ``samples`` (entity, frame): mean number of detections (frame) over all sampled frames, those without any included."""
    counts = dets.groupBy("frame").agg(F.count(F.lit(1)).alias("n"))
    return samples.join(counts, "frame", "left").groupBy("entity").agg(F.avg(F.coalesce("n", F.lit(0))).alias("clutter"), F.count(F.lit(1)).alias("n_frames"))


def switch_rate(series: DataFrame, name: str) -> DataFrame:
    """Per entity: how often ``name`` changes from one sample to the next, among the n - 1 steps."""
    before = F.lag(name).over(Window.partitionBy("entity").orderBy("frame"))
    return series.withColumn("_s", (F.col(name) != before).cast("int")).groupBy("entity").agg((F.count(F.lit(1)) - 1).alias("n"), F.avg("_s").alias("rate"))
