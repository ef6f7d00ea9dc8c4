"""Gates: which detections, entities and frames count, and what stands in where they don't."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def of_class(names: list[str] | None, least: float = 0.0) -> Column:
    """Detections of some classes (None: any) with a confidence of ``least`` or more."""
    sure = F.col("conf") >= least
    return sure & F.col("cls").isin(names) if names else sure


def mentions(text: Column, words: list[str]) -> Column:
    """Whether a text has one of ``words`` in any case."""
    return F.lower(text).rlike("|".join(map(re.escape, words)))


def compound(entities: DataFrame, centers: DataFrame, threshold: float, least_single: float, exempt: str) -> DataFrame:
    """Per row of ``entities`` (entity, kind): gated (no centre, or too cluttered unless of the exempt kind), traced and the centre.

    ``traced``: not gated, and of the exempt kind or with one subject in ``least_single`` of its frames or more.
    """
    r = entities.join(centers, "entity", "left").withColumn("gated", F.col("median").isNull() | ((F.col("kind") != exempt) & (F.col("clutter") > threshold)))
    single = F.coalesce("single", F.lit(0.0)) >= least_single
    return r.select("entity", "kind", "gated", (~F.col("gated") & ((F.col("kind") == exempt) | single)).alias("traced"), F.when(F.col("gated"), 0.5).otherwise(F.col("median")).alias("center"))


def distance_grid(centers: DataFrame, distances: list[float]) -> DataFrame:
    """For each distance: centres nearer to the middle than that are gated to it; counts and the mean centre. The grid is as long as the list."""
    grid = F.explode(F.array(*map(F.lit, distances))).alias("least")
    near = F.abs(F.col("median") - 0.5) < F.col("least")
    return centers.select("median", grid).groupBy("least").agg(F.count(F.lit(1)).alias("n"), F.count_if(near).alias("n_gated"), F.avg(F.when(near, 0.5).otherwise(F.col("median"))).alias("mean_center"))


def sign_consistent(centers: DataFrame, others: DataFrame) -> DataFrame:
    """Per entity of ``centers`` (entity, median): its centre where that of ``others`` lies on the same side of the middle, else 0.5; ``gated`` tells. An entity that ``others`` lacks is gated."""
    r = centers.select("entity", "median").join(others.select("entity", F.col("median").alias("_o")), "entity", "left")
    same = F.coalesce(F.signum(F.round("median", 9) - 0.5) == F.signum(F.round("_o", 9) - 0.5), F.lit(False))
    return r.select("entity", F.when(same, F.col("median")).otherwise(0.5).alias("center"), (~same).alias("gated"))


def with_evidence(rows: DataFrame, name: str, least: int) -> DataFrame:
    """Entities with ``least`` values or more that aren't all alike: n, mean, sd."""
    return rows.groupBy("entity").agg(F.count(name).alias("n"), F.avg(name).alias("mean"), F.stddev_pop(name).alias("sd")).where((F.col("n") >= least) & (F.col("sd") > 1e-9))


def capped_drop(rows: DataFrame, most: float) -> DataFrame:
    """``drop`` taken back for entities where it would take more than ``most`` of the rows."""
    w = Window.partitionBy("entity")
    return rows.withColumn("drop", F.col("drop") & (F.sum(F.col("drop").cast("int")).over(w) <= most * F.count(F.lit(1)).over(w)))


def slates(samples: DataFrame, targets: DataFrame, least_dark: float, most_mean: float) -> DataFrame:
    """``samples`` (entity, frame, mean, dark) with ``slate``: dark, and no target (entity, frame) there."""
    have = targets.select("entity", "frame").distinct().withColumn("_t", F.lit(True))
    dark = (F.col("dark") >= least_dark) & (F.col("mean") <= most_mean)
    return samples.join(have, ["entity", "frame"], "left").withColumn("slate", dark & F.col("_t").isNull()).drop("_t")


def edge_runs(samples: DataFrame, gap: int) -> DataFrame:
    """Per entity of ``samples`` (entity, frame, slate): the last sample of the run of slates at the head (-1: none) and the first of that at the tail (n: none).

    Samples count by their place. A run goes on over ``gap`` other samples at most, if a slate follows.
    """
    w = Window.partitionBy("entity").orderBy("frame")
    rows = samples.select("entity", "slate", (F.row_number().over(w) - 1).alias("i"), F.count(F.lit(1)).over(Window.partitionBy("entity")).alias("n"))
    at = Window.partitionBy("entity").orderBy("i")
    back = Window.partitionBy("entity").orderBy(F.col("i").desc())
    on = rows.where("slate").withColumn("wide", (F.col("i") - F.coalesce(F.lag("i").over(at), F.lit(-1)) > gap + 1).cast("int")).withColumn("far", (F.coalesce(F.lead("i").over(at), F.col("n")) - F.col("i") > gap + 1).cast("int"))
    on = on.withColumn("broken", F.max("wide").over(at)).withColumn("late", F.max("far").over(back))
    ends = on.groupBy("entity").agg(F.max(F.when(F.col("broken") == 0, F.col("i"))).alias("h"), F.min(F.when(F.col("late") == 0, F.col("i"))).alias("t"))
    return rows.groupBy("entity").agg(F.first("n").alias("n")).join(ends, "entity", "left").select("entity", F.coalesce("h", F.lit(-1)).cast("long").alias("head_end"), F.coalesce(F.col("t").cast("long"), "n").alias("tail_start"))


def slate_drop(frames: DataFrame, samples: DataFrame, gap: int, most: float) -> DataFrame:
    """``frames`` (entity, frame) without those whose latest sample lies in a run of slates at the head or tail.

    A frame before the first sample takes that one. Entities that would lose more than ``most`` of their frames, and those without samples, lose none.
    """
    w = Window.partitionBy("entity").orderBy("frame")
    place = samples.select("entity", "frame", (F.row_number().over(w) - 1).alias("i"))
    both = frames.select("entity", "frame").withColumn("_f", F.lit(True)).join(place, ["entity", "frame"], "full_outer")
    latest = both.withColumn("i", F.coalesce(F.last("i", True).over(w), F.lit(0))).where("_f")
    marked = latest.join(edge_runs(samples, gap), "entity", "left").withColumn("drop", F.coalesce((F.col("i") <= F.col("head_end")) | (F.col("i") >= F.col("tail_start")), F.lit(False)))
    return capped_drop(marked, most).where("NOT drop").select("entity", "frame")


def quantile_cut(rows: DataFrame, name: str, share: float) -> DataFrame:
    """``rows`` with ``kept``: not above the (1 - ``share``) quantile, interpolated, of ``name``."""
    cut = rows.agg(F.percentile(name, F.lit(1 - share)).alias("_cut"))  # one row
    return rows.join(F.broadcast(cut)).withColumn("kept", F.col(name) <= F.col("_cut")).drop("_cut")
