"""Statistics over groups: ranks, slopes, shrinkage, bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def auc(rows: DataFrame, score: str, positive: Column) -> DataFrame:
    """Area under the ROC curve per entity from tie-averaged ranks; null where a class is empty."""
    order = Window.partitionBy("entity").orderBy(score)
    peers = Window.partitionBy("entity", score)
    ranked = rows.withColumn("_pos", positive.cast("int")).withColumn("_rank", F.rank().over(order) + (F.count(F.lit(1)).over(peers) - 1) / 2)
    out = ranked.groupBy("entity").agg(F.sum("_pos").alias("n_pos"), F.sum(1 - F.col("_pos")).alias("n_neg"), F.sum(F.col("_pos") * F.col("_rank")).alias("r"))
    return out.select("entity", "n_pos", "n_neg", F.expr("try_divide(r - n_pos * (n_pos + 1) / 2, n_pos * n_neg)").alias("auc"))


def shrinkage(rows: DataFrame, truth: str, estimate: str) -> DataFrame:
    """Per entity: correlation, slope of truth on estimate (the best pull to the mean), both variances and n."""
    return rows.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.corr(truth, estimate).alias("r"), F.regr_slope(truth, estimate).alias("beta"), F.var_samp(estimate).alias("var_estimate"), F.covar_samp(truth, estimate).alias("cov"))


def leave_one_out(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Slope of ``y`` on ``x`` refitted without each row, from sums over the entity less the row's own."""
    w = Window.partitionBy("entity")
    n = F.count(F.lit(1)).over(w) - 1
    less = lambda e: F.sum(e).over(w) - e
    a, b = F.col(x), F.col(y)
    slope = F.try_divide(n * less(a * b) - less(a) * less(b), n * less(a * a) - less(a) * less(a))
    return rows.withColumn("loo_slope", slope)


def binned(rows: DataFrame, by: str, edges: list[float], value: str) -> DataFrame:
    """Count and mean of ``value`` in half-open bins; the last one is open above, values below the first edge have bin 0."""
    number = sum(((F.col(by) >= e).cast("int") for e in edges), F.lit(0))
    return rows.groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
