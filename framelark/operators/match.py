"""Joins by position: latest and nearest samples, intervals, boxes, fallbacks between sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sample_at(probes: DataFrame, samples: DataFrame) -> DataFrame:
    """For each of ``probes`` (entity, frame) the latest of ``samples`` (entity, frame, y) up to it and the nearest: asof, nearest, distance.

    Before the first sample that one counts; of equally near ones the earlier. Both sides go to one sorted pass over the entity's frames.
    """
    rows = probes.select("entity", "frame").distinct().withColumn("_p", F.lit(True)).join(samples.select("entity", "frame", "y"), ["entity", "frame"], "full_outer")
    w = Window.partitionBy("entity").orderBy("frame")
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    s = F.when(F.col("y").isNotNull(), F.struct("frame", "y"))
    r = rows.withColumn("b", F.last(s, True).over(before)).withColumn("a", F.first(s, True).over(after)).where("_p")
    later = F.col("b").isNull() | (F.col("a.frame") - F.col("frame") < F.col("frame") - F.col("b.frame"))
    near = F.when(later, F.col("a")).otherwise(F.col("b"))
    return r.select("entity", "frame", F.coalesce("b.y", "a.y").alias("asof"), near["y"].alias("nearest"), F.abs(near["frame"] - F.col("frame")).alias("distance"))


def in_interval(frames: DataFrame, intervals: DataFrame, factor: float = 1.0) -> DataFrame:
    """``frames`` (entity, frame) inside their entity's half-open interval (entity, start, end), made wider by ``factor``; all of them where there is none, it is empty, or nothing lies inside."""
    both = frames.join(intervals.select("entity", "start", "end"), "entity", "left")
    middle, half = (F.col("start") + F.col("end")) / 2, (F.col("end") - F.col("start")) / 2 * factor
    inside = F.coalesce((F.col("end") > F.col("start")) & (F.col("frame") >= middle - half) & (F.col("frame") < middle + half), F.lit(False))
    marked = both.withColumn("_in", inside).withColumn("_any", F.bool_or("_in").over(Window.partitionBy("entity")))
    return marked.where(F.col("_in") | ~F.col("_any")).drop("_in", "_any", "start", "end")


def containing(points: DataFrame, spans: DataFrame, point: Column, keys: tuple[str, ...] = ("entity",)) -> DataFrame:
    """Rows of ``points`` whose ``point`` lies in a span (entity, lo, hi, name) of its entity, both ends included: one row for each pair. With ``keys`` entity and frame only spans of the same frame count."""
    return points.withColumn("_x", point).join(spans, list(keys)).where((F.col("_x") >= F.col("lo")) & (F.col("_x") <= F.col("hi"))).drop("_x")


def coverage(truth: DataFrame, dets: DataFrame) -> DataFrame:
    """Per entity of ``truth`` (entity, frame, lo, hi): share of its frames with a detection (entity, frame, c) whose centre lies inside."""
    inside = truth.join(dets.select("entity", "frame", "c"), ["entity", "frame"], "left").withColumn("_in", F.coalesce((F.col("c") >= F.col("lo")) & (F.col("c") <= F.col("hi")), F.lit(False)))
    each = inside.groupBy("entity", "frame").agg(F.bool_or("_in").alias("_in"))
    return each.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("_in").cast("int")).alias("coverage"))


def raster_cover(spans: DataFrame, boxes: DataFrame, points: int = 24) -> DataFrame:
    """Per entity and frame of ``spans`` (x0, y0, x1, y1): share of ``points`` x ``points`` places of the span that lie in one of its boxes (entity, frame, x0, y0, x1, y1).

    The boxes of a frame are one array, so the raster is walked inside a row and never joined.
    """
    b = boxes.groupBy("entity", "frame").agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("boxes"))
    r = spans.join(b, ["entity", "frame"], "left").withColumn("boxes", F.coalesce("boxes", F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>")))
    axis = lambda lo, hi: F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.col(lo) + (F.col(hi) - F.col(lo)) * i / (points - 1))
    column = lambda x, acc: acc + F.size(F.filter(axis("y0", "y1"), lambda y: F.exists("boxes", lambda q: (x >= q["x0"]) & (x <= q["x1"]) & (y >= q["y0"]) & (y <= q["y1"]))))
    return r.withColumn("hit", F.aggregate(axis("x0", "x1"), F.lit(0), lambda acc, x: column(x, acc))).select("entity", "frame", (F.col("hit") / (points * points)).alias("cover"))


def first_of(rows: DataFrame, sources: list[DataFrame], key: str, value: str) -> DataFrame:
    """``rows`` with ``value`` from the first of ``sources`` (one row a key) that has it, and ``source``: its number from 0 (null: none)."""
    names = [f"_v{i}" for i in range(len(sources))]
    for n, s in zip(names, sources, strict=True):
        rows = rows.join(s.select(key, F.col(value).alias(n)), key, "left")
    which = None
    for i, n in enumerate(names):
        which = F.when(F.col(n).isNotNull(), i) if which is None else which.when(F.col(n).isNotNull(), i)
    return rows.withColumn(value, F.coalesce(*names)).withColumn("source", which).drop(*names)


def switch(rows: DataFrame, condition: Column, special: DataFrame, main: DataFrame, key: str, value: str) -> DataFrame:
    """``rows`` with ``value`` from ``special`` where the condition holds and it has the key, else from ``main``."""
    r = rows.join(special.select(key, F.col(value).alias("_s")), key, "left").join(main.select(key, F.col(value).alias("_m")), key, "left")
    return r.withColumn(value, F.when(condition, F.coalesce("_s", "_m")).otherwise(F.col("_m"))).drop("_s", "_m")


def either(a: DataFrame, b: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """Two caches of a flag as one: true where either says so; a key of one alone keeps its word."""
    return a.select(*keys, flag).unionByName(b.select(*keys, flag)).groupBy(*keys).agg(F.bool_or(flag).alias(flag))


def with_reason(rows: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """``rows`` with the manifest's columns and ``miss``: why there is nothing (no name, or not found)."""
    m = manifest.withColumn("_there", F.lit(True))
    return rows.join(m, key, "left").withColumn("miss", F.when(F.col(key).isNull(), "no name").when(F.col("_there").isNull(), "not found")).drop("_there")
