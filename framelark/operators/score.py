"""Scoring predictions against truth, and comparing two runs without any."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import iou
from ..sources.folders import partitions_of

BOX = ["x", "y", "w", "h"]


def first_per_frame(rows: DataFrame, order: list, keys: tuple[str, ...] = ("entity", "frame")) -> DataFrame:
    """The first row of each key by ``order``."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def score_entities(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Per entity of ``truth``: n_pred, n_truth, matched, sum_iou, f1 = 2 * sum_iou / (n_pred + n_truth), null where both are 0.

    Both have entity, frame and a box, one row a frame. A frame is matched where both have it. Entities without predictions stay.
    """
    p = pred.select("entity", "frame", F.struct(*BOX).alias("p"), F.lit(None).alias("t"))
    t = truth.select("entity", "frame", F.lit(None).alias("p"), F.struct(*BOX).alias("t"))
    # one shuffle by entity serves the match and both counts, none where rows lie so already; a task's share doesn't grow with the input
    n = partitions_of(p.unionByName(t))
    both = p.repartition(n, "entity").unionByName(t.repartition(n, "entity"))
    frames = both.groupBy("entity", "frame").agg(F.first("p", True).alias("p"), F.first("t", True).alias("t"))
    value = F.when(F.col("p").isNotNull() & F.col("t").isNotNull(), iou(*(F.col(f"{s}.{c}") for s in "pt" for c in BOX)))
    out = frames.groupBy("entity").agg(F.count("p").alias("n_pred"), F.count("t").alias("n_truth"), F.count(value).alias("matched"), F.coalesce(F.sum(value), F.lit(0.0)).alias("sum_iou"))
    return out.where("n_truth > 0").withColumn("f1", F.expr("try_divide(2 * sum_iou, n_pred + n_truth)"))


def macro(scores: DataFrame) -> DataFrame:
    """One row: means of f1 with null left out, as 0 and as 1; totals."""
    return scores.agg(F.avg("f1").alias("f1_skip"), F.avg(F.coalesce("f1", F.lit(0.0))).alias("f1_zero"), F.avg(F.coalesce("f1", F.lit(1.0))).alias("f1_one"), F.sum("n_pred").alias("n_pred"), F.sum("n_truth").alias("n_truth"), F.sum("matched").alias("matched"), (F.sum("sum_iou") / F.sum("matched")).alias("mean_iou"))


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per entity: frames of either run and of both, their Jaccard index, and the mean distance of boxes in shared frames."""
    rows = a.select("entity", "frame", F.col("x").alias("ax")).join(b.select("entity", "frame", F.col("x").alias("bx")), ["entity", "frame"], "full_outer")
    return rows.groupBy("entity").agg(F.count("ax").alias("n_a"), F.count("bx").alias("n_b"), F.count(F.col("ax") + F.col("bx")).alias("shared"), (F.count(F.col("ax") + F.col("bx")) / F.count(F.lit(1))).alias("jaccard"), F.avg(F.abs(F.col("ax") - F.col("bx"))).alias("mean_offset"))
