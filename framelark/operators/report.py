"""Reports over scores and runs: quantiles by index, totals, bins, verdicts, picks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import partitions_of, shared_folder


def placed(rows: DataFrame, lead: Column, order: list, parts: int = 32) -> DataFrame:
    """``rows`` with their ``place`` (from 1) in a global order, of which ``lead`` (a number, ascending; nulls last) is the first part.

    Rows go to ranges of the whole order, so rows with equal ``lead`` spread as well, are sorted there and written once with their place in the range; a range begins after the rows of
    the ranges before. No task sorts all rows, and the input runs twice (a sample for the ranges, then the rows).
    """
    spark = rows.sparkSession
    by = [lead.cast("double").asc_nulls_last(), *order]
    path = shared_folder(spark, "places")
    ranges = rows.repartitionByRange(max(parts, partitions_of(rows)), *by).sortWithinPartitions(*by)
    # the upper bits of the number are the range, the lower 33 the place in it
    ranges.withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    back = spark.read.parquet(path).withColumn("_range", F.shiftright("_at", 33))
    # a row for each range
    before = back.groupBy("_range").agg(F.count(F.lit(1)).alias("_m")).withColumn("_before", F.sum("_m").over(Window.orderBy("_range")) - F.col("_m")).drop("_m")
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return back.join(F.broadcast(before), "_range").withColumn("place", within + F.col("_before") + 1).drop("_at", "_range", "_before")


def samples(rows: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each key by ``order``."""
    return rows.withColumn("_p", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_p") <= n).drop("_p")


def index_quantiles(rows: DataFrame, name: str, shares: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """One row with the values at place floor(n * q) of the sorted values (from 0), nulls left out: q25, q50, ... Not interpolated; the median is the upper one."""
    # a number of its own lets rows of one value spread over ranges; it doesn't show in the result
    values = rows.where(F.col(name).isNotNull()).select(F.col(name).alias("v"), F.monotonically_increasing_id().alias("i"))
    values = placed(values, F.col("v"), ["v", "i"])
    n = values.count()
    at = lambda q: F.max(F.when(F.col("place") == min(math.floor(n * q), n - 1) + 1, F.col("v"))).alias(f"q{round(q * 100)}")
    return values.agg(*map(at, shares))


def totals(scores: DataFrame) -> DataFrame:
    """One row over scored entities: sums, predictions a true frame (k), recall, precision, mean overlap of matched frames."""
    t = scores.agg(F.sum("n_truth").alias("n_truth"), F.sum("n_pred").alias("n_pred"), F.sum("matched").alias("matched"), F.sum("sum_iou").alias("s"))
    part = lambda a, b: F.try_divide(F.col(a), F.col(b))
    return t.select("n_truth", "n_pred", "matched", part("n_pred", "n_truth").alias("k"), part("matched", "n_truth").alias("recall"), part("matched", "n_pred").alias("precision"), part("s", "matched").alias("mean_iou"))


def levels(name: str, edges: list[tuple[float, str]], rest: str) -> Column:
    """The name of the first edge that a value reaches, edges from the highest down; ``rest`` below all."""
    out = None
    for edge, label in edges:
        out = F.when(F.col(name) >= edge, label) if out is None else out.when(F.col(name) >= edge, label)
    return out.otherwise(rest)


def bucket_report(rows: DataFrame, bucket: Column, values: list[str]) -> DataFrame:
    """Count and means for each bucket, and over all (``ALL``)."""
    r = rows.withColumn("bucket", bucket).rollup("bucket").agg(F.grouping("bucket").alias("g"), F.count(F.lit(1)).alias("n"), *(F.avg(v).alias(v) for v in values))
    return r.withColumn("bucket", F.when(F.col("g") == 1, "ALL").otherwise(F.col("bucket"))).drop("g")


def win_loss(rows: DataFrame, delta: str, epsilon: float = 1e-9) -> DataFrame:
    """One row: wins, losses, ties, mean and its standard error."""
    d = F.col(delta)
    return rows.agg(F.count_if(d > epsilon).alias("wins"), F.count_if(d < -epsilon).alias("losses"), F.count_if(F.abs(d) <= epsilon).alias("ties"), F.avg(d).alias("mean"), (F.stddev_samp(d) / F.sqrt(F.count(d))).alias("se"))


def run_verdict(compared: DataFrame) -> DataFrame:
    """One row over compared entities (jaccard, mean_offset, width): means, and what kind of change it is."""
    t = compared.agg(F.avg("jaccard").alias("jaccard"), F.percentile("mean_offset", F.lit(0.5)).alias("offset"), F.percentile("width", F.lit(0.5)).alias("width"))
    relative = F.coalesce(F.try_divide(F.col("offset"), F.col("width")), F.lit(0.0))
    kind = F.when(F.col("jaccard") < 0.9, "REAL").when(F.col("jaccard") < 0.98, "MINOR").when(relative >= 0.05, "BOX-ONLY").otherwise("LABEL NOISE")
    return t.select("jaccard", "offset", relative.alias("relative"), kind.alias("verdict"))


def dice(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per entity: twice the shared frames over the frames of both sets (entity, frame, distinct)."""
    both = a.select("entity", "frame").withColumn("a", F.lit(1)).join(b.select("entity", "frame").withColumn("b", F.lit(1)), ["entity", "frame"], "full_outer")
    return both.groupBy("entity").agg((2 * F.count(F.col("a") + F.col("b")) / (F.count("a") + F.count("b"))).alias("dice"))


def set_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per entity: frames in both, only in ``a``, only in ``b``, in either."""
    both = a.select("entity", "frame").withColumn("a", F.lit(1)).join(b.select("entity", "frame").withColumn("b", F.lit(1)), ["entity", "frame"], "full_outer")
    n = F.count(F.col("a") + F.col("b"))
    return both.groupBy("entity").agg(n.alias("both"), (F.count("a") - n).alias("only_a"), (F.count("b") - n).alias("only_b"), F.count(F.lit(1)).alias("either"))


def top_share_mean(rows: DataFrame, by: Column, value: str, shares: list[float], ties: list) -> DataFrame:
    """For each share the mean of ``value`` over that part of the rows with the largest ``by``; the shares are few."""
    first = placed(rows, -by, [by.desc(), *ties])
    n = first.count()
    each = first.select("place", value, F.explode(F.array(*map(F.lit, shares))).alias("share")).where(F.col("place") <= F.rint(F.col("share") * n))
    return each.groupBy("share").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))


def round_robin(lists: list[tuple[DataFrame, str]], most: int) -> DataFrame:
    """Keys picked from ranked lists (key, place) in turn: all first places, then all second ones; a key counts once, where it comes first."""
    rows = None
    for i, (df, key) in enumerate(lists):
        part = df.where(F.col("place") <= most).select(F.col(key).alias("key"), "place", F.lit(i).alias("list"))
        rows = part if rows is None else rows.unionByName(part)
    once = rows.groupBy("key").agg(F.min(F.struct("place", "list")).alias("m"))
    # as many rows as there are lists, times ``most``
    ranked = once.withColumn("turn", F.row_number().over(Window.orderBy("m.place", "m.list", "key")))
    return ranked.where(F.col("turn") <= most).select("key", "turn")


def spread_sample(rows: DataFrame, lead: Column, order: list, n: int) -> DataFrame:
    """Rows spread evenly over an order, about 4 * ``n`` of them: every ``step``-th from the first on."""
    step = max(1, rows.count() // (n * 4))
    return placed(rows, lead, order).where((F.col("place") - 1) % step == 0).drop("place")


def numeric_first(name: str) -> list[Column]:
    """An order of ids that are numbers by their value, then of all others as text."""
    return [F.coalesce(F.col(name).try_cast("long"), F.lit((1 << 63) - 1)), F.col(name)]
