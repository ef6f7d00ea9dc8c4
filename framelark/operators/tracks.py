"""Tracks and masks: statistics, a main one by rule, pooled centres."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rules by name over the statistics of a track.
TRACK_RULES = {
    "pres*area": lambda: F.col("presence") * F.col("mean_area"),
    "pres*maxarea": lambda: F.col("presence") * F.col("max_area"),
    "integrated": lambda: F.col("sum_area"),
    "presence": lambda: F.col("presence"),
    "meanarea": lambda: F.col("mean_area"),
    "pres*area*conf": lambda: F.col("presence") * F.col("mean_area") * F.col("mean_conf"),
}
#: Weights by name over the masks of a frame.
MASK_RULES = {
    "area_w": lambda: F.col("area"),
    "sqrt_area_w": lambda: F.sqrt("area"),
    "iou_area_w": lambda: F.col("area") * F.col("iou"),
    "iou_w": lambda: F.col("iou"),
}


def track_stats(entries: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """Per entity and track of ``entries`` (entity, track, frame, area, conf, cls, pos): presence, areas, confidence, the class first seen.

    Presence is among the sampled frames of the entity (``samples``: entity, n_sampled), or among its frames that have entries where no samples are given.
    """
    frames = entries.groupBy("entity").agg(F.count_distinct("frame").alias("_n")) if samples is None else samples.select("entity", F.col("n_sampled").alias("_n"))
    out = entries.groupBy("entity", "track").agg(
        F.count(F.lit(1)).alias("n"), F.avg("area").alias("mean_area"), F.sum("area").alias("sum_area"), F.max("area").alias("max_area"), F.avg("conf").alias("mean_conf"),
        F.min_by("cls", F.struct("frame", "pos")).alias("first_cls"),
    )
    return out.join(frames, "entity").withColumn("presence", F.col("n") / F.greatest(F.lit(1), F.col("_n"))).drop("_n")


def pick_main(stats: DataFrame, rule: str) -> DataFrame:
    """The track of each entity with the largest score by ``rule`` (a name of ``TRACK_RULES``); ties: the lowest track."""
    order = Window.partitionBy("entity").orderBy(F.col("score").desc(), "track")
    return stats.withColumn("score", F.round(TRACK_RULES[rule](), 9)).withColumn("_p", F.row_number().over(order)).where("_p = 1").select("entity", "track", "score")


def fused_centers(entries: DataFrame, rule: str, only: str | None = None) -> DataFrame:
    """Per entity and frame: the entries' centres weighted by their track's score, held in 0..1. ``only``: tracks first seen as that class."""
    weights = track_stats(entries).withColumn("w", TRACK_RULES[rule]()).where("w > 0")
    weights = weights.where(F.col("first_cls") == only) if only else weights
    both = entries.join(weights.select("entity", "track", "w"), ["entity", "track"])
    return both.groupBy("entity", "frame").agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.sum(F.col("w") * F.col("c")) / F.sum("w"))).alias("center"))


def mask_centers(masks: DataFrame, top: int | None = None) -> DataFrame:
    """Per entity and frame one centre for each rule: of the largest mask, of the box around all, and the weighted means of ``MASK_RULES``.

    ``masks``: entity, frame, c, area, iou, x0, x1, pos. ``top``: only that many largest masks of a frame count.
    """
    if top:
        order = Window.partitionBy("entity", "frame").orderBy(F.col("area").desc(), "pos")
        masks = masks.withColumn("_p", F.row_number().over(order)).where(F.col("_p") <= top)
    mean = lambda w: F.try_divide(F.sum(w * F.col("c")), F.sum(w))
    largest = F.min_by("c", F.struct((-F.col("area")).alias("a"), "pos")).alias("largest")
    return masks.groupBy("entity", "frame").agg(largest, ((F.min("x0") + F.max("x1")) / 2).alias("extent"), *(mean(w()).alias(name) for name, w in MASK_RULES.items()))


def subject_priority(first: DataFrame, second: DataFrame, names: tuple[str, str]) -> DataFrame:
    """Per entity all frames of ``first`` (entity, frame, center) if it has any, else those of ``second``; ``kind`` tells which."""
    kinds = [x.withColumn("kind", F.lit(n)) for x, n in zip((first, second), names, strict=True)]
    return kinds[0].unionByName(kinds[1].join(first.select("entity").distinct(), "entity", "left_anti"))


def argmax_series(samples: DataFrame, dets: DataFrame, score: Column, ties: list) -> DataFrame:
    """For each of ``samples`` (entity, frame) the detection with the largest ``score``: c, score, cls; 0.5, 0 and ``-`` where there is none."""
    order = Window.partitionBy("entity", "frame").orderBy(F.col("score").desc(), *ties)
    best = dets.withColumn("score", score).withColumn("_p", F.row_number().over(order)).where("_p = 1").select("entity", "frame", "c", "score", "cls")
    out = samples.join(best, ["entity", "frame"], "left")
    return out.select("entity", "frame", F.coalesce("c", F.lit(0.5)).alias("c"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("cls", F.lit("-")).alias("cls"))
