"""Ordered series: one row for each entity and frame."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def whole():
    return Window.partitionBy("entity")


def by_frame():
    return whole().orderBy("frame")


def zscore(x: Column) -> Column:
    """Distance from the entity's mean in population deviations; 0 for a flat series."""
    sd = F.stddev_pop(x).over(whole())
    return F.when(sd > 1e-9, (x - F.avg(x).over(whole())) / sd).otherwise(0.0)


def minmax(x: Column) -> Column:
    lo, hi = F.min(x).over(whole()), F.max(x).over(whole())
    return F.when(hi > lo, (x - lo) / (hi - lo)).otherwise(0.0)


def robust(series: DataFrame, name: str, lo: float = 0.1, hi: float = 0.9) -> DataFrame:
    """Adds ``robust``: the value between two percentiles, held in 0..1; 0 for a flat series."""
    edges = series.groupBy("entity").agg(F.percentile(name, F.lit(lo)).alias("_lo"), F.percentile(name, F.lit(hi)).alias("_hi"))
    x = (F.col(name) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    return series.join(edges, "entity").withColumn("robust", F.when(F.col("_hi") > F.col("_lo"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))).otherwise(0.0)).drop("_lo", "_hi")


def moving_average(x: Column, half: int) -> Column:
    """Mean over 2 * half + 1 frames; the first and last value stand in beyond the ends."""
    around = by_frame().rowsBetween(-half, half)
    left = F.greatest(F.lit(0), half - (F.row_number().over(by_frame()) - 1))
    right = F.greatest(F.lit(0), half - (F.count(F.lit(1)).over(whole()) - F.row_number().over(by_frame())))
    first, last = F.first(x).over(by_frame().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.last(x).over(by_frame().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return (F.sum(x).over(around) + left * first + right * last) / (2 * half + 1)


def median3(x: Column) -> Column:
    """Median of a value and its neighbours; a missing neighbour is the value itself."""
    a, b = F.coalesce(F.lag(x).over(by_frame()), x), F.coalesce(F.lead(x).over(by_frame()), x)
    return F.greatest(F.least(a, b), F.least(F.greatest(a, b), x))


def ema(series: DataFrame, name: str, alpha: float = 0.3) -> DataFrame:
    """Exponential average from the first value on, as (entity, frame, ema); null values are left out.

    A value counts ``alpha`` times the decay of the frames since. Blocks of a series are summed with windows, scaled inside each block so that nothing overflows; a block takes
    over the end of the one before, and of that one's predecessor, beyond which less than 1e-60 of a value is left.
    """
    decay = 1 - min(1.0, max(1e-3, alpha))
    size = math.ceil(70 / -math.log(decay)) if decay else 1
    i = F.row_number().over(by_frame()) - 1
    rows = series.where(F.col(name).isNotNull()).select("entity", "frame", F.col(name).cast("double").alias("x"), i.alias("i"))
    rows = rows.withColumn("b", F.floor(F.col("i") / size)).withColumn("p", (F.col("i") % size).cast("double"))
    share = F.col("x") * F.when(F.col("i") == 0, 1.0).otherwise(1 - decay)
    if not decay:
        return rows.select("entity", "frame", F.col("x").alias("ema"))
    inside = Window.partitionBy("entity", "b").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("s", F.sum(share * F.pow(F.lit(decay), -F.col("p"))).over(inside) * F.pow(F.lit(decay), "p"))
    blocks = Window.partitionBy("entity").orderBy("b")
    ends = rows.groupBy("entity", "b").agg(F.max_by("s", "p").alias("end"))
    before = F.coalesce(F.lag("end").over(blocks), F.lit(0.0)) + decay**size * F.coalesce(F.lag("end", 2).over(blocks), F.lit(0.0))
    return rows.join(ends.select("entity", "b", before.alias("carry")), ["entity", "b"]).select("entity", "frame", (F.col("s") + F.pow(F.lit(decay), F.col("p") + 1) * F.col("carry")).alias("ema"))


def densify(samples: DataFrame, lengths: DataFrame) -> DataFrame:
    """(entity, frame, y, prev_frame, prev, next_frame, next) on the grid 0..n-1 of ``lengths`` (entity, n) from ``samples`` (entity, frame, y)."""
    grid = lengths.select("entity", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("frame"))
    rows = grid.join(samples.select("entity", "frame", "y"), ["entity", "frame"], "left")
    before, after = by_frame().rowsBetween(Window.unboundedPreceding, 0), by_frame().rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col("y").isNotNull(), F.col("frame"))
    return rows.select("entity", "frame", "y", F.last(at, True).over(before).alias("prev_frame"), F.last("y", True).over(before).alias("prev"), F.first(at, True).over(after).alias("next_frame"), F.first("y", True).over(after).alias("next"))


def interpolate(samples: DataFrame, lengths: DataFrame) -> DataFrame:
    """Linear between samples, held at the ends; adds the latest sample before (``asof``; the first one before any) and the nearest (ties: earlier)."""
    r = densify(samples, lengths)
    step = F.try_divide(F.col("frame") - F.col("prev_frame"), F.col("next_frame") - F.col("prev_frame"))
    line = F.when(F.col("prev").isNull(), F.col("next")).when(F.col("next").isNull() | (F.col("next_frame") == F.col("prev_frame")), F.col("prev")).otherwise(F.col("prev") + (F.col("next") - F.col("prev")) * step)
    near = F.when(F.col("prev").isNull() | (F.col("next_frame") - F.col("frame") < F.col("frame") - F.col("prev_frame")), F.col("next")).otherwise(F.col("prev"))
    return r.select("entity", "frame", line.alias("linear"), F.coalesce("prev", "next").alias("asof"), near.alias("nearest"))
