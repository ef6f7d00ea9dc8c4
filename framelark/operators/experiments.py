"""How good an estimate must be: noise on the truth, the inclusion rule at its fixed point, fits with several features, arms of one track."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import center_to_box, kept_frames, shrink
from . import score, sequence, tracks, trials, windows

BOX = ["x", "y", "w", "h"]


def normal(*parts: Column) -> Column:
    """A standard normal number from the text of some columns (Box-Muller over two hash draws); the same columns give the same number again."""
    u = lambda k: (trials.draw(*parts, F.lit(k)) + 0.5) / float(1 << 32)
    return F.sqrt(-2 * F.log(u(1))) * F.cos(2 * math.pi * u(2))


def box_row(center: Column) -> list[Column]:
    """The box of a clip's size (width, crop, h) around a centre on the x axis."""
    return [center_to_box(center, F.col("width"), F.col("crop")).cast("double").alias("x"), F.lit(0.0).alias("y"), F.col("crop").cast("double").alias("w"), F.col("h").cast("double").alias("h")]


def mean_f1(pred: DataFrame, truth: DataFrame, by: str) -> DataFrame:
    """Mean F1 over the entities of ``truth`` for each value of ``by`` (a column of ``pred``; ``truth`` has the entities of every value)."""
    key = F.struct(F.col(by).alias("by"), "entity").alias("entity")
    scores = score.score_entities(pred.select(key, "frame", *BOX), truth.select(key, "frame", *BOX))
    return scores.groupBy(F.col("entity.by").alias(by)).agg(F.avg("f1").alias("f1"))


def noise_curve(truth: DataFrame, clips: DataFrame, clutter: DataFrame, sigmas: list[float], step: int = 5, drop: float = 0.08, most_clutter: float = 2.0) -> DataFrame:
    """For each sigma the mean F1 of three arms whose estimates are the true centres plus normal noise: a constant at the median, the trajectory, and the constant gated by clutter.

    ``truth``: entity, frame, box. ``clips``: entity, n (frames), width, crop, h. ``clutter``: entity, clutter. Every ``step``-th kept frame has an estimate, from the nearest true
    frame (ties: the earlier), held in 0..1. Between estimates the trajectory is linear. Entities without truth take no part.
    """
    arms = F.explode(F.array(*(F.struct(F.lit(i).alias("k"), F.lit(float(s)).alias("sigma")) for i, s in enumerate(sigmas)))).alias("g")
    lengths = clips.join(truth.select("entity").distinct(), "entity", "left_semi").withColumn("kept", kept_frames(F.col("n"), drop))
    true = truth.join(clips.select("entity", "width"), "entity").select("entity", "frame", ((F.col("x") + F.col("w") / 2) / F.col("width")).alias("y"))
    # the grid reaches the last true frame, so that one beyond the clip's kept part can be the nearest
    ends = true.groupBy("entity").agg(F.max("frame").alias("top"))
    reach = lengths.join(ends, "entity").select("entity", F.greatest(F.col("kept"), F.col("top") + 1).alias("n"))
    near = sequence.interpolate(true, reach).select("entity", "frame", "nearest").join(lengths.select("entity", "kept"), "entity").where((F.col("frame") < F.col("kept")) & (F.col("frame") % step == 0))
    est = near.select("entity", "frame", "nearest", arms).select(F.struct("g.k", "entity").alias("entity"), "frame", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("nearest") + F.col("g.sigma") * normal(F.col("g.k"), F.col("entity"), F.col("frame")))).alias("y"))
    medians = est.groupBy("entity").agg(F.percentile("y", F.lit(0.5)).alias("m"))
    all_clips = lengths.join(clutter.select("entity", "clutter"), "entity", "left").select(arms, "*").select(F.struct("g.k", "entity").alias("key"), "g.k", "entity", "kept", "width", "crop", "h", F.coalesce("clutter", F.lit(0.0)).alias("clutter"))
    line = sequence.interpolate(est, all_clips.select(F.col("key").alias("entity"), F.col("kept").alias("n"))).select(F.col("entity").alias("key"), "frame", F.col("linear").alias("traj"))
    sized = all_clips.join(medians.select(F.col("entity").alias("key"), "m"), "key")
    frames = line.join(sized, "key")
    kinds = {"const": F.col("m"), "traj": F.col("traj"), "gated": F.when(F.col("clutter") > most_clutter, 0.5).otherwise(F.col("m"))}
    one = frames.select("k", "entity", "frame", "width", "crop", "h", F.explode(F.array(*(F.struct(F.lit(a).alias("arm"), c.alias("c")) for a, c in kinds.items()))).alias("a"))
    pred = one.select(F.struct("k", "a.arm").alias("what"), "entity", "frame", *box_row(F.col("a.c")))
    cells = F.explode(F.array(*(F.struct(F.lit(i).alias("k"), F.lit(a).alias("arm")) for i in range(len(sigmas)) for a in kinds))).alias("what")
    got = mean_f1(pred, truth.join(lengths.select("entity"), "entity", "left_semi").select("entity", "frame", *BOX, cells), "what")
    sigma = F.element_at(F.array(*(F.lit(float(s)) for s in sigmas)), F.col("k") + 1)
    pick = lambda a: F.max(F.when(F.col("what.arm") == a, F.col("f1"))).alias(a)
    return got.groupBy(F.col("what.k").alias("k")).agg(*(pick(a) for a in kinds)).select(sigma.alias("sigma"), *kinds)


def nearest_ceiling(truth: DataFrame, clips: DataFrame, drop: float = 0.08) -> DataFrame:
    """Per entity of ``truth`` the F1 of boxes that stand, on every kept frame of its clip (entity, n), where the nearest true box stands (ties: the earlier): what a perfect centre reaches without knowing which frames count."""
    last = truth.groupBy("entity").agg(F.max("frame").alias("top"))
    kept = clips.select("entity", kept_frames(F.col("n"), drop).alias("kept")).join(last, "entity")
    boxes = truth.select("entity", "frame", F.struct(*BOX).alias("y"))
    near = sequence.interpolate(boxes.withColumn("y", F.col("y.x")), kept.select("entity", F.greatest(F.col("kept"), F.col("top") + 1).alias("n"))).select("entity", "frame", "nearest")
    size = truth.groupBy("entity").agg(F.first("y").alias("y"), F.first("w").alias("w"), F.first("h").alias("h"))
    pred = near.join(kept.select("entity", "kept"), "entity").where(F.col("frame") < F.col("kept")).join(size, "entity").select("entity", "frame", F.col("nearest").alias("x"), "y", "w", "h")
    return score.score_entities(pred, truth).select("entity", "f1")


def marginal_inclusion(series: DataFrame, hit: Column, overlap: float, bins: int = 50, most_rounds: int = 20) -> DataFrame:
    """The rounds of the rule "keep a part of the clip if its hit rate is above F1 / (2 * overlap)", until nothing changes: round, threshold, n_bins, n_kept, f1, settled.

    Only the ``bins`` rows of the histogram of hits by position come to the driver. F1 is that of all frames together, 2 * overlap * hits / (kept + truth). Round 0 keeps
    all. The rule may swing between two sets of parts; then ``most_rounds`` ends it and no round is settled. A series without frames has no rounds.
    """
    if overlap <= 0:
        raise ValueError("the mean overlap must be above 0")
    hist = windows.hit_rate_by_position(series, hit, bins).collect()
    n, rate = np.array([r.n for r in hist], float), np.array([r.rate for r in hist], float)
    hits, kept, out = n * rate, np.ones(len(hist), bool), []
    threshold = None
    for k in range(most_rounds + 1 if len(hist) else 0):
        f1 = 2 * overlap * hits[kept].sum() / (n[kept].sum() + hits.sum()) if n[kept].sum() + hits.sum() else 0.0
        out.append([k, threshold, int(kept.sum()), int(n[kept].sum()), float(f1), False])
        threshold = float(f1 / (2 * overlap))
        after = rate > threshold
        if (after == kept).all():
            out[-1][-1] = True
            break
        kept = after
    return series.sparkSession.createDataFrame(list(map(tuple, out)), "round int, threshold double, n_bins int, n_kept long, f1 double, settled boolean")


def linear_fit(rows: DataFrame, y: str, features: list[str]) -> DataFrame:
    """``rows`` with ``fitted`` and ``left_out``: least squares of ``y`` on an intercept and up to six features, and the prediction of the fit without the row.

    One row of sums of products comes to the driver, where the normal equations are solved; features that depend on others share their weight (least norm). What leaving a row out changes
    follows from its leverage; a row that alone decides a weight (leverage 1) has no prediction. Rows with a null among ``y`` and features take no part and get nulls.
    """
    if len(features) > 6:
        raise ValueError("six features at most")
    cols = [F.lit(1.0), *(F.col(f).cast("double") for f in features)]
    whole = F.col(y).isNotNull()
    for f in features:
        whole = whole & F.col(f).isNotNull()
    used = rows.where(whole)
    # sums about the means, which keeps the equations well conditioned
    means = used.agg(*(F.avg(f).alias(f"m{i}") for i, f in enumerate(features)), F.avg(y).alias("my"), F.count(F.lit(1)).alias("n")).first()
    if not means["n"]:
        return rows.withColumn("fitted", F.lit(None).cast("double")).withColumn("left_out", F.lit(None).cast("double"))
    centred = [c - (means[f"m{i}"] if means[f"m{i}"] is not None else 0.0) for i, c in enumerate(cols[1:])]
    k = len(features)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = used.agg(F.count(F.lit(1)).alias("n"), *(F.sum(centred[i] * centred[j]).alias(f"s{i}_{j}") for i, j in pairs), *(F.sum(centred[i] * (F.col(y) - means["my"])).alias(f"t{i}") for i in range(k))).first()
    a = np.zeros((k, k))
    for i, j in pairs:
        a[i, j] = a[j, i] = sums[f"s{i}_{j}"]
    inverse = np.linalg.pinv(a, rcond=1e-10, hermitian=True) if k else a
    weights = inverse @ np.array([sums[f"t{i}"] for i in range(k)]) if k else np.zeros(0)
    fitted = sum((float(w) * c for w, c in zip(weights, centred, strict=True)), F.lit(float(means["my"])))
    leverage = sum((float(inverse[i, j]) * centred[i] * centred[j] for i in range(k) for j in range(k)), F.lit(1.0 / means["n"]))
    r = rows.withColumn("fitted", F.when(whole, fitted))
    rest = 1 - leverage
    return r.withColumn("left_out", F.when(whole & (F.abs(rest) > 1e-9), F.col(y) - (F.col(y) - F.col("fitted")) / rest))


def fit_report(fits: dict[str, DataFrame], y: str, estimate: str, clips: DataFrame, truth: DataFrame, drop: float = 0.08) -> DataFrame:
    """For each named fit (entity, ``y``, ``estimate``, left_out): R2 and root mean square error of predictions without the row, the mean F1 of constant boxes there, and the share of the
    estimate's mean error that the fit takes away (``credit``). ``clips``: entity, n, width, crop, h."""
    out = None
    for name, fit in fits.items():
        part = fit.where(F.col("left_out").isNotNull()).select(F.lit(name).alias("model"), "entity", F.col(y).alias("y"), F.col(estimate).alias("e"), "left_out")
        out = part if out is None else out.unionByName(part)
    wrong = F.col("y") - F.col("left_out")
    quality = out.groupBy("model").agg(F.count(F.lit(1)).alias("n"), (1 - F.avg(wrong * wrong) / F.var_pop("y")).alias("r2"), F.sqrt(F.avg(wrong * wrong)).alias("rmse"), (1 - F.avg(F.abs(wrong)) / F.avg(F.abs(F.col("e") - F.col("y")))).alias("credit"))
    sized = out.join(clips, "entity").withColumn("kept", kept_frames(F.col("n"), drop))
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("left_out")))
    pred = sized.select("model", "entity", "width", "crop", "h", c.alias("c"), F.explode(F.sequence(F.lit(0), F.col("kept") - 1)).alias("frame")).select("model", "entity", "frame", *box_row(F.col("c")))
    real = truth.join(out.select("model", "entity"), "entity").select("model", "entity", "frame", *BOX)
    return quality.join(mean_f1(pred, real, "model"), "model", "left").select("model", "n", "r2", "rmse", "f1", "credit")


def track_arms(entries: DataFrame, clips: DataFrame, truth: DataFrame, rules: list[str], betas: list[float] = (0.37, 0.5, 1.0), drop: float = 0.08) -> DataFrame:
    """Mean F1 of arms of the main track by each rule: constants at its median pulled to the middle by each beta, and its trajectory, beside the centred control.

    ``entries``: entity, track, frame, c, area, conf, cls, pos; ``clips``: entity, n, width, crop, h. Frames are the kept ones of each clip. A clip without tracks is centred. Returns arm, f1.
    """
    stats = tracks.track_stats(entries)
    lengths = clips.withColumn("kept", kept_frames(F.col("n"), drop))
    grid = lengths.select("entity", "width", "crop", "h", F.explode(F.sequence(F.lit(0), F.col("kept") - 1)).alias("frame"))
    parts = [grid.select(F.lit("control").alias("arm"), "entity", "frame", *box_row(F.lit(0.5)))]
    for rule in rules:
        main = entries.join(tracks.pick_main(stats, rule).select("entity", "track"), ["entity", "track"])
        path = main.groupBy("entity", "frame").agg(F.min_by("c", "pos").alias("y"))
        median = path.groupBy("entity").agg(F.percentile("y", F.lit(0.5)).alias("m"))
        line = sequence.interpolate(path, lengths.select("entity", "n")).select("entity", "frame", "linear")
        both = grid.join(median, "entity", "left").join(line, ["entity", "frame"], "left")
        middle = F.coalesce("m", F.lit(0.5))
        kinds = [(f"{rule} const {b:g}", shrink(middle, b)) for b in betas] + [(f"{rule} frame", F.coalesce("linear", F.lit(0.5)))]
        one = both.select("entity", "frame", "width", "crop", "h", F.explode(F.array(*(F.struct(F.lit(a).alias("arm"), c.alias("c")) for a, c in kinds))).alias("a"))
        parts.append(one.select("a.arm", "entity", "frame", *box_row(F.col("a.c"))))
    pred = parts[0]
    for p in parts[1:]:
        pred = pred.unionByName(p)
    names = ["control", *(f"{r} {k}" for r in rules for k in [*(f"const {b:g}" for b in betas), "frame"])]
    real = truth.join(lengths.select("entity"), "entity", "left_semi").select(F.explode(F.array(*map(F.lit, names))).alias("arm"), "entity", "frame", *BOX)
    return mean_f1(pred, real, "arm")
