"""Windows over ordered series: averages of any width, scores of several signals, resampling, keyframes, thresholds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sequence import by_frame, minmax, whole, zscore


def _around(name: str, left: int, right: int) -> Column:
    """The values from ``left`` frames before to ``right`` after as an array; the first and last value stand in beyond the ends."""
    values = F.collect_list(name).over(by_frame().rowsBetween(-left, right))
    i, n = F.row_number().over(by_frame()), F.count(F.lit(1)).over(whole())
    pad = lambda count, v: F.array_repeat(v, F.greatest(F.lit(0), count).cast("int"))
    return F.concat(pad(left - i + 1, values[0]), values, pad(right - (n - i), F.element_at(values, -1)))


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values)


def _median(values: Column) -> Column:
    s = F.array_sort(values)
    half = F.floor((F.size(s) - 1) / 2).cast("int")
    return (F.get(s, half) + F.get(s, F.size(s) - 1 - half)) / 2


def average(name: str, width: int) -> Column:
    """Mean over ``width`` frames; an even width reaches one frame further back than ahead."""
    return _mean(_around(name, width // 2, width - 1 - width // 2))


def smooth(name: str, width: int) -> Column:
    """Mean over ``width`` frames, made odd; a series under three frames stays as it is."""
    half = max(1, width) // 2
    return F.when(F.count(F.lit(1)).over(whole()) < 3, F.col(name)).otherwise(_mean(_around(name, half, half)))


def median(name: str, width: int) -> Column:
    """Median over ``width`` frames, made odd."""
    half = max(1, width) // 2
    return _median(_around(name, half, half))


def combined_score(series: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``series`` with ``score``: the weighted sum of its signals, each brought to 0..1 and then to deviations; signals that aren't there are left out."""
    there = {k: w for k, w in weights.items() if k in series.columns and w}
    for k in there:
        series = series.withColumn(f"_{k}", minmax(F.col(k)))
    total = sum((w * zscore(F.col(f"_{k}")) for k, w in there.items()), F.lit(0.0))
    return series.withColumn("score", total).drop(*(f"_{k}" for k in there))


def weighted_mean_score(weights: dict[str, float]) -> Column:
    """Mean of the signals of a row, weighted; a null signal is left out and the others' weights fill its share."""
    have = lambda k: F.when(F.col(k).isNotNull(), F.lit(weights[k])).otherwise(0.0)
    return F.try_divide(sum((have(k) * F.coalesce(k, F.lit(0.0)) for k in weights), F.lit(0.0)), sum((have(k) for k in weights), F.lit(0.0)))


def sliding(series: DataFrame, name: str, length: int) -> DataFrame:
    """Sum and mean of every full window of ``length`` frames, by its first frame."""
    ahead = by_frame().rowsBetween(0, length - 1)
    r = series.withColumn("sum", F.sum(name).over(ahead)).withColumn("_k", F.count(F.lit(1)).over(ahead))
    return r.where(F.col("_k") == length).select("entity", "frame", "sum", (F.col("sum") / length).alias("mean"))


def resample(series: DataFrame, name: str, k: int) -> DataFrame:
    """``k`` points spread evenly over each series, linear between its points; a single point is repeated."""
    i, n = F.row_number().over(by_frame()) - 1, F.count(F.lit(1)).over(whole())
    rows = series.select("entity", i.alias("i"), n.alias("n"), F.col(name).alias("v"), F.lead(name).over(by_frame()).alias("next"))
    at = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("point")
    # each point belongs to the one segment that holds it
    pos = F.col("point") * (F.col("n") - 1) / (k - 1)
    ends = rows.select("*", at).withColumn("pos", pos).where((F.floor("pos") == F.col("i")))
    return ends.select("entity", "point", (F.col("v") + F.coalesce((F.col("next") - F.col("v")) * (F.col("pos") - F.col("i")), F.lit(0.0))).alias("value"))


def keyframes(series: DataFrame, every: int) -> DataFrame:
    """Every ``every``-th frame and always the last one."""
    last = F.max("frame").over(whole())
    return series.withColumn("_l", last).where((F.col("frame") % every == 0) | (F.col("frame") == F.col("_l"))).drop("_l")


def centred_fallback(valid: DataFrame, clips: DataFrame) -> DataFrame:
    """Keyframe answers (entity, frame, center); for clips (entity, n) without any, their first and last frame at the middle."""
    none = clips.join(valid.select("entity").distinct(), "entity", "left_anti").where("n > 0")
    ends = none.select("entity", F.explode(F.array_distinct(F.array(F.lit(0).cast("long"), F.col("n") - 1))).alias("frame"), F.lit(0.5).alias("center"))
    return valid.select("entity", "frame", "center").unionByName(ends)


def hit_rate_by_position(series: DataFrame, hit: Column, bins: int) -> DataFrame:
    """Share of hits in equal parts of each series, over all series."""
    n = F.count(F.lit(1)).over(whole())
    r = series.withColumn("_hit", hit.cast("int")).withColumn("bin", F.floor(bins * F.col("frame") / n).cast("int"))
    return r.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("_hit").alias("rate"))


def position_window(series: DataFrame, lo: float, hi: float) -> DataFrame:
    """Frames in [lo * n, hi * n) of their series."""
    n = F.count(F.lit(1)).over(whole())
    return series.withColumn("_n", n).where((F.col("frame") >= lo * F.col("_n")) & (F.col("frame") < hi * F.col("_n"))).drop("_n")


def drop_tail(series: DataFrame, share: float) -> DataFrame:
    """Frames before round((1 - share) * n)."""
    n = F.count(F.lit(1)).over(whole())
    return series.withColumn("_n", n).where(F.col("frame") < F.rint((1 - share) * F.col("_n"))).drop("_n")


def hull(frames: DataFrame) -> DataFrame:
    """First and last frame of each entity."""
    return frames.groupBy("entity").agg(F.min("frame").alias("start"), F.max("frame").alias("end"))


def nearest_runs(frame: np.ndarray, v: np.ndarray, share: float, k: int, gap: int) -> np.ndarray:
    """Which values of one series, in order of ``frame``, ``threshold_windows`` keeps."""
    target, lo, hi, best = max(1, round(share * len(v))), v.min(), v.max(), None
    for _ in range(40):
        th = (lo + hi) / 2
        at = np.flatnonzero(v >= th)
        # a run ends where the next frame above is too far
        ends = np.flatnonzero(np.append(np.diff(frame[at]) > gap, True)) if len(at) else at
        first, last = at[np.append(0, ends[:-1] + 1)] if len(at) else at, at[ends] if len(at) else at
        order = np.lexsort((first, frame[last] - frame[first]))[::-1][:k]
        keep = np.zeros(len(v), bool)
        for r in order:
            keep[first[r] : last[r] + 1] = True
        if best is None or abs(keep.sum() - target) < abs(best.sum() - target):
            best = keep
        lo, hi = (th, hi) if keep.sum() > target else (lo, th)
    return best


def threshold_windows(series: DataFrame, name: str, share: float, k: int, gap: int) -> DataFrame:
    """Per entity the frames of the ``k`` longest runs above a threshold that comes nearest to round(share * n) frames.

    Runs with ``gap`` frames or fewer from one to the next are one; of equally long ones the later counts. The threshold is found by halving the range of
    values 40 times, and the nearest result so far is kept (the earlier of equals). The search needs a whole series at once: a group for each entity.
    """
    kinds = dict(series.dtypes)

    def one(pdf):
        pdf = pdf.sort_values("frame")
        return pdf[nearest_runs(pdf["frame"].to_numpy(), pdf[name].to_numpy(float), share, k, gap)][["entity", "frame"]]

    return series.select("entity", "frame", name).groupBy("entity").applyInPandas(one, f"entity {kinds['entity']}, frame {kinds['frame']}")


def best_segments(series: DataFrame, name: str, share: float) -> DataFrame:
    """Per entity the hull of the best window of round(share * n) frames and, if its mean is 0.8 of the best or more, of the best one apart from it: start, end (half-open), windows."""
    n, i = F.count(F.lit(1)).over(whole()), F.row_number().over(by_frame()) - 1
    rows = series.select("entity", i.alias("i"), n.alias("n"), F.sum(name).over(by_frame()).alias("s"), F.col(name).alias("v"))
    rows = rows.withColumn("len", F.greatest(F.lit(1), F.rint(share * F.col("n"))).cast("int"))
    ends = rows.select("entity", (F.col("i") - F.col("len") + 1).alias("i"), F.col("s").alias("e"))
    means = rows.join(ends, ["entity", "i"]).select("entity", "i", "len", F.round((F.col("e") - F.col("s") + F.col("v")) / F.col("len"), 9).alias("mean"))
    best = lambda df: df.groupBy("entity").agg(F.max(F.struct("mean", (-F.col("i")).alias("back"), "len")).alias("m"))
    first = best(means).select("entity", (-F.col("m.back")).alias("a"), F.col("m.mean").alias("top"))
    apart = means.join(first, "entity").where((F.col("i") >= F.col("a") + F.col("len")) | (F.col("i") + F.col("len") <= F.col("a")))
    second = best(apart).select("entity", (-F.col("m.back")).alias("b"), F.col("m.mean").alias("next"))
    both = means.groupBy("entity").agg(F.first("len").alias("len")).join(first, "entity").join(second, "entity", "left").withColumn("two", F.coalesce(F.col("next") >= 0.8 * F.col("top"), F.lit(False)))
    low, high = F.when(F.col("two"), F.least("a", "b")).otherwise(F.col("a")), F.when(F.col("two"), F.greatest("a", "b")).otherwise(F.col("a"))
    return both.select("entity", low.alias("start"), (high + F.col("len")).alias("end"), F.when(F.col("two"), 2).otherwise(1).alias("windows"))


#: Selectors by name: a series (entity, frame, score) to the frames (entity, frame) that stay. None adds a frame.
SELECTORS = {
    "keep_all": lambda s: s,
    "drop_tail": lambda s: drop_tail(s, 0.08),
    "position_window": lambda s: position_window(s, 0.16, 0.88),
    "top_fraction": lambda s: _top_fraction(s, 0.6),
    "best_window": lambda s: _window(s, 0.6),
    "threshold_windows": lambda s: threshold_windows(s, "score", 0.6, 2, 15),
}


def _top_fraction(s: DataFrame, share: float) -> DataFrame:
    from .intervals import top_fraction

    return top_fraction(s, "score", share)


def _window(s: DataFrame, share: float) -> DataFrame:
    from .intervals import best_window

    w = best_window(s, "score", share).select("entity", "start", "length")
    return s.join(w, "entity").where((F.col("frame") >= F.col("start")) & (F.col("frame") < F.col("start") + F.col("length"))).drop("start", "length")


def select(series: DataFrame, name: str) -> DataFrame:
    return SELECTORS[name](series).select("entity", "frame")


def added(selected: DataFrame, series: DataFrame) -> DataFrame:
    """Frames of a selection that its series doesn't have: none, if the selector is sound."""
    return selected.select("entity", "frame").join(series.select("entity", "frame"), ["entity", "frame"], "left_anti")


def selector_matrix(series: DataFrame, truth: DataFrame, names: list[str]) -> DataFrame:
    """For each selector: frames kept, their share, and the mean over entities of the Dice overlap with ``truth`` (entity, frame)."""
    out = None
    for name in names:
        one = select(series, name).withColumn("name", F.lit(name))
        out = one if out is None else out.unionByName(one)
    total = series.groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    real = truth.groupBy("entity").agg(F.count(F.lit(1)).alias("t"))
    hit = out.join(truth.select("entity", "frame").withColumn("hit", F.lit(1)), ["entity", "frame"], "left").groupBy("name", "entity").agg(F.count(F.lit(1)).alias("k"), F.count("hit").alias("h"))
    each = hit.join(total, "entity").join(real, "entity", "left")
    return each.groupBy("name").agg(F.sum("k").alias("n_kept"), (F.sum("k") / F.sum("n")).alias("keep_ratio"), F.avg(2 * F.col("h") / (F.col("k") + F.coalesce("t", F.lit(0)))).alias("dice"))
