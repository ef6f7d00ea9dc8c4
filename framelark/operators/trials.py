"""Experiments over per-entity results: splits, resampling, grids, fits. Splits and draws come from hashes, so that every run repeats them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(*parts: Column) -> Column:
    """A number in [0, 2^32) from the text of some columns."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(p.cast("string") for p in parts))), 1, 8), 16, 10).cast("long")


def over_grid(rows: DataFrame, name: str, values: list[float]) -> DataFrame:
    """``rows`` once for each of a short list of parameter values."""
    return rows.withColumn(name, F.explode(F.array(*map(F.lit, values))))


def halves(rows: DataFrame, splits: int, key: str = "entity") -> DataFrame:
    """``rows`` once for each split (0 .. splits - 1) with ``train``: about half of the keys, another half each time."""
    return rows.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1)))).withColumn("train", draw(F.col("split"), F.col(key)) % 2 == 0)


def displacement(rows: DataFrame, value: str) -> DataFrame:
    """One row: spread between the entities' medians (bias) and the mean spread inside them (jitter), of entities with three values or more."""
    each = rows.groupBy("entity").agg(F.count(value).alias("n"), F.percentile(value, F.lit(0.5)).alias("m"), F.stddev_pop(value).alias("sd")).where("n >= 3")
    return each.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("m").alias("bias_sd"), F.avg("sd").alias("jitter_sd"))


def held_out_slope(rows: DataFrame, truth: str, estimate: str, splits: int) -> DataFrame:
    """Per split: the slope fitted on the train half, and how much nearer to the truth it brings the other half than the middle does (``gain``)."""
    r = halves(rows, splits)
    fit = r.where("train").groupBy("split").agg(F.regr_slope(truth, estimate).alias("beta"))
    # a row for each split
    test = r.where("NOT train").join(F.broadcast(fit), "split")
    pulled = 0.5 + F.col("beta") * (F.col(estimate) - 0.5)
    return test.groupBy("split").agg(F.first("beta").alias("beta"), F.avg(F.abs(F.col(truth) - 0.5) - F.abs(F.col(truth) - pulled)).alias("gain"))


def summary(gains: DataFrame, name: str) -> DataFrame:
    """One row over splits: mean, its standard error and the share of wins."""
    return gains.agg(F.count(F.lit(1)).alias("n"), F.avg(name).alias("mean"), (F.stddev_pop(name) / F.sqrt(F.count(F.lit(1)))).alias("se"), F.avg((F.col(name) > 0).cast("int")).alias("wins"))


def bootstrap(rows: DataFrame, delta: str, rounds: int) -> DataFrame:
    """One row: mean of ``delta``, its 95 % interval over ``rounds`` resamplings and whether it spans 0.

    Every row counts in each round as often as a Poisson draw of mean 1 says, so rows never meet and the rounds are sums.
    """
    u = draw(F.col("round"), F.col("entity")) / float(1 << 32)
    steps = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]  # of the Poisson distribution
    weight = sum(((u >= p).cast("int") for p in steps), F.lit(0))
    r = rows.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn("w", weight)
    means = r.groupBy("round").agg((F.sum(F.col("w") * F.col(delta)) / F.sum("w")).alias("m"))
    ends = means.agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return rows.agg(F.avg(delta).alias("mean")).join(ends).select("mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), ((F.col("q")[0] > 0) | (F.col("q")[1] < 0)).alias("significant"))


def picked_on_half(rows: DataFrame, parameter: str, gain: str, splits: int) -> DataFrame:
    """Per split: the parameter value with the largest mean ``gain`` on the train half (ties: the least), and its mean on the other half. ``rows``: a row for each entity and value."""
    r = halves(rows, splits).groupBy("split", parameter).agg(F.round(F.avg(F.when(F.col("train"), F.col(gain))), 9).alias("a"), F.avg(F.when(~F.col("train"), F.col(gain))).alias("held_out"))
    order = Window.partitionBy("split").orderBy(F.col("a").desc(), parameter)
    return r.withColumn("_p", F.row_number().over(order)).where("_p = 1").select("split", parameter, "held_out")


def held_out_cuts(rows: DataFrame, stat: str, delta: str, shares: list[float], splits: int) -> DataFrame:
    """For each share q: the mean over splits of what the held-out half gains if ``delta`` counts only at or below the (1 - q) quantile of ``stat`` on the train half, its standard error, and the mean cut."""
    r = halves(rows, splits)
    cuts = r.where("train").groupBy("split").agg(F.percentile(stat, F.array(*(F.lit(1 - q) for q in shares))).alias("cs"))
    cuts = cuts.select("split", F.explode(F.arrays_zip(F.array(*map(F.lit, shares)).alias("q"), F.col("cs").alias("cut"))).alias("z")).select("split", "z.q", "z.cut")
    # a row for each split and share
    test = r.where("NOT train").join(F.broadcast(cuts), "split")
    each = test.groupBy("q", "split").agg(F.avg(F.when(F.col(stat) <= F.col("cut"), F.col(delta)).otherwise(0.0)).alias("gain"), F.first("cut").alias("cut"))
    return each.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.avg("gain").alias("mean"), (F.stddev_samp("gain") / F.sqrt(F.count(F.lit(1)))).alias("se"), F.avg("cut").alias("cut"))


def grid_curve(rows: DataFrame, parameter: str, gain: str) -> DataFrame:
    """Per parameter value: mean gain and its standard error."""
    return rows.groupBy(parameter).agg(F.count(F.lit(1)).alias("n"), F.avg(gain).alias("mean"), (F.stddev_samp(gain) / F.sqrt(F.count(F.lit(1)))).alias("se"))


def two_feature_fit(rows: DataFrame, y: str, a: str, b: str) -> DataFrame:
    """``rows`` with ``fitted`` and ``left_out``: least squares of ``y`` on two features, and the prediction of a fit without the row.

    The normal equations come from sums over all rows (one row, broadcast); what leaving a row out changes follows from its leverage.
    """
    sums = {"n": F.count(F.lit(1)).cast("double"), "ma": F.avg(a), "mb": F.avg(b), "my": F.avg(y), "saa": F.var_pop(a), "sbb": F.var_pop(b), "sab": F.covar_pop(a, b), "say": F.covar_pop(a, y), "sby": F.covar_pop(b, y)}
    m = rows.agg(F.struct(*(v.alias(k) for k, v in sums.items())).alias("_m"))
    n, ma, mb, my, saa, sbb, sab, say, sby = (F.col("_m")[k] for k in sums)
    det, da, db = saa * sbb - sab * sab, F.col(a) - ma, F.col(b) - mb
    fitted = my + (say * sbb - sby * sab) / det * da + (sby * saa - say * sab) / det * db
    leverage = (1 + (da * da * sbb - 2 * da * db * sab + db * db * saa) / det) / n
    r = rows.join(F.broadcast(m)).withColumn("fitted", fitted)
    return r.withColumn("left_out", F.col(y) - (F.col(y) - F.col("fitted")) / (1 - leverage)).select(*rows.columns, "fitted", "left_out")


def fit_quality(fitted: DataFrame, y: str) -> DataFrame:
    """One row: R2 of the predictions of fits without the row, and their root mean square error."""
    e = F.col(y) - F.col("left_out")
    return fitted.agg((1 - F.avg(e * e) / F.var_pop(y)).alias("r2"), F.sqrt(F.avg(e * e)).alias("rmse"))


def features(rows: DataFrame, value: str) -> DataFrame:
    """Per entity: median, spread, half spread, log of 1 + count."""
    return rows.groupBy("entity").agg(F.percentile(value, F.lit(0.5)).alias("median"), F.stddev_pop(value).alias("sd"), ((F.max(value) - F.min(value)) / 2).alias("half_spread"), F.log1p(F.count(value).cast("double")).alias("log_n"))


def transfer(deltas: DataFrame, target: DataFrame) -> DataFrame:
    """One row: mean of the bins' deltas (bin, delta) weighted by the target's counts (bin, n); bins without a delta count as 0."""
    return target.join(deltas, "bin", "left").agg((F.sum(F.coalesce("delta", F.lit(0.0)) * F.col("n")) / F.sum("n")).alias("expected"))


def agreement(rows: DataFrame, a: Column, b: Column) -> DataFrame:
    """One row over two answers: how often they differ, how often they lie on the same side of the middle, and the mean difference where they do."""
    same = F.signum(a - 0.5) == F.signum(b - 0.5)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg((F.abs(a - b) > 1e-9).cast("int")).alias("differ"), F.avg(same.cast("int")).alias("same_side"), F.avg(F.when(same, a - b)).alias("difference"))


def profile(rows: DataFrame) -> DataFrame:
    """One row over (entity, frame): entities, rows, rows an entity (least, mean, most) and the commonest step between frames."""
    each = rows.groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    step = F.col("frame") - F.lag("frame").over(Window.partitionBy("entity").orderBy("frame"))
    common = rows.select(step.alias("step")).where("step IS NOT NULL").groupBy("step").agg(F.count(F.lit(1)).alias("m")).agg(F.max(F.struct("m", (-F.col("step")).alias("s"))).alias("x"))
    return each.agg(F.count(F.lit(1)).alias("entities"), F.sum("n").alias("rows"), F.min("n").alias("least"), F.avg("n").alias("mean"), F.max("n").alias("most")).join(common).select("entities", "rows", "least", "mean", "most", (-F.col("x.s")).alias("step"))
