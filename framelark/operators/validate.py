"""Row-level checks with one error code for each row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def check(rows: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """``rows`` (entity, frame, x, y, w, h, pos, n_frames, width, height) with ``code`` (null: valid) and ``soft``.

    The first failing rule counts: missing, frame, bbox (also a number that isn't finite), bounds (beyond the frame by more than ``tolerance``), then dup for a
    frame that an earlier valid row (by ``pos``) has. ``soft``: valid, but beyond the frame within the tolerance.
    """
    infinite = F.lit(float("inf"))
    unsound = F.exists(F.array("x", "y", "w"), lambda v: F.isnan(v) | (F.abs(v) == infinite))
    bad_frame = F.isnan("frame") | (F.col("frame") < 0) | (F.col("frame") != F.floor("frame")) | (F.col("frame") >= F.col("n_frames"))
    right, bottom = F.col("x") + F.col("w"), F.col("y") + F.col("h")
    code = (
        F.when(F.col("frame").isNull() | F.col("x").isNull() | F.col("y").isNull() | F.col("w").isNull(), "missing")
        .when(bad_frame, "frame")
        .when(unsound | (F.col("x") < 0) | (F.col("y") < 0) | (F.col("w") <= 0), "bbox")
        .when((right > F.col("width") + tolerance) | (bottom > F.col("height") + tolerance), "bounds")
    )
    rows = rows.withColumn("code", code)
    turn = F.row_number().over(Window.partitionBy("entity", "frame", F.col("code").isNull()).orderBy("pos"))
    rows = rows.withColumn("code", F.when(F.col("code").isNull() & (turn > 1), "dup").otherwise(F.col("code")))
    return rows.withColumn("soft", F.col("code").isNull() & ((right > F.col("width")) | (bottom > F.col("height"))))


def repeated(rows: DataFrame, key: str, order: list) -> DataFrame:
    """Rows of a key beyond its first one by ``order``."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n > 1").drop("_n")


def size_violations(rows: DataFrame, limit: float = 9216.0) -> DataFrame:
    """(rule, n) for the model sizes of a submission (entity, size): not positive and finite (a row each), then over all: only some, several, limit."""
    sound = (F.col("size") > 0) & ~F.isnan("size") & (F.col("size") < float("inf"))
    t = rows.agg(F.count(F.lit(1)).alias("n"), F.count("size").alias("given"), F.count_if(sound).alias("good"), F.count_distinct(F.when(sound, F.col("size"))).alias("kinds"), F.max(F.when(sound, F.col("size"))).alias("top"))
    found = F.array(
        F.struct(F.lit("invalid").alias("rule"), (F.col("given") - F.col("good")).alias("n")),
        F.struct(F.lit("partial").alias("rule"), F.when((F.col("good") > 0) & (F.col("good") < F.col("n")), F.col("n") - F.col("good")).alias("n")),
        F.struct(F.lit("several").alias("rule"), F.when(F.col("kinds") > 1, F.col("kinds")).alias("n")),
        F.struct(F.lit("limit").alias("rule"), F.when(F.col("top") > limit, F.lit(1).cast("long")).alias("n")),
    )
    return t.select(F.explode(found).alias("v")).where("v.n > 0").select("v.rule", "v.n")


def against_index(found: DataFrame, index: DataFrame) -> DataFrame:
    """(entity, code) over ``found`` and ``index`` (entity, tw, th): missing, unknown, or ratio where both are there and differ."""
    a, b = found.select("entity", F.struct("tw", "th").alias("a")), index.select("entity", F.struct("tw", "th").alias("b"))
    code = F.when(F.col("a").isNull(), "missing").when(F.col("b").isNull(), "unknown").when(F.col("a") != F.col("b"), "ratio")
    return a.join(b, "entity", "full_outer").withColumn("code", code).where("code IS NOT NULL").select("entity", "code")


def without(rows: DataFrame, known: DataFrame, key: str = "entity") -> DataFrame:
    """Keys of ``rows`` that ``known`` doesn't have."""
    return rows.select(key).distinct().join(known.select(key), key, "left_anti")


def strict(rows: DataFrame, known: DataFrame, key: str = "entity") -> DataFrame:
    """``rows`` joined with ``known``; ValueError where a key is missing from it."""
    lost = without(rows, known, key).limit(5).collect()
    if lost:
        raise ValueError(f"no entry for {[r[0] for r in lost]}")
    return rows.join(known, key)


def unsorted(rows: DataFrame) -> DataFrame:
    """Entities whose frames don't ascend in the order of ``pos``."""
    back = F.col("frame") < F.lag("frame").over(Window.partitionBy("entity").orderBy("pos"))
    return rows.withColumn("_b", back).groupBy("entity").agg(F.bool_or("_b").alias("_b")).where("_b").select("entity")


def report(violations: DataFrame, most: int = 5) -> DataFrame:
    """For each code: how often, the first ``most`` entities, and whether the whole passes (never, as there are violations)."""
    first = F.row_number().over(Window.partitionBy("code").orderBy("entity"))
    return violations.withColumn("_p", first).groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(F.col("_p") <= most, F.col("entity")))).alias("sample"))


def verdict(violations: DataFrame) -> DataFrame:
    """One row: number of violations, and ``passed``."""
    return violations.agg(F.count(F.lit(1)).alias("n_violations"), (F.count(F.lit(1)) == 0).alias("passed"))


def sane_truth(rows: DataFrame) -> DataFrame:
    """Per entity of ``rows`` (entity, frame, n_frames): rows inside the clip, and why the entity is skipped (``empty``: none is)."""
    inside = (F.col("frame") >= 0) & (F.col("frame") < F.col("n_frames"))
    out = rows.groupBy("entity").agg(F.count("frame").alias("n"), F.count_if(inside).alias("n_kept"))
    return out.withColumn("skip", F.when(F.col("n") == 0, "no rows").when(F.col("n_kept") == 0, "empty"))
