"""Whole arms: from signals, detections and a base run to the boxes of a submission.

Clips are (entity, n, width, height, cw, ch, axis): frames, picture, crop and the axis along which the crop moves (``x``, ``y`` or ``none``). Boxes are (entity, frame, x, y, w).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import crop_size, free_axis, shrink
from ..functions.replies import let
from . import gates, pool, selection, sequence, windows

PETS = ["cat", "dog"]


def sized(clips: DataFrame) -> DataFrame:
    """``clips`` (entity, n, width, height, tw, th) with their crop and its free axis."""
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    cw, ch = crop_size(w, h, F.col("tw"), F.col("th"))
    c = clips.withColumn("cw", cw).withColumn("ch", ch)
    return c.withColumn("axis", free_axis(F.col("width"), F.col("height"), F.col("cw"), F.col("ch")))


def travel() -> Column:
    """How far the crop can move on its axis."""
    return F.when(F.col("axis") == "x", F.col("width") - F.col("cw")).when(F.col("axis") == "y", F.col("height") - F.col("ch")).otherwise(0).cast("double")


def start(center: Column) -> Column:
    """Where a crop around a centre begins on its axis, held inside the picture, not rounded."""
    side = F.when(F.col("axis") == "x", center * F.col("width") - F.col("cw") / 2).otherwise(center * F.col("height") - F.col("ch") / 2)
    return F.when(F.col("axis") == "none", 0.0).otherwise(F.greatest(F.lit(0.0), F.least(side, travel())))


def placed(offset: Column) -> list[Column]:
    """x, y, w of a crop that begins at ``offset``; without a free axis it is centred."""
    at = F.rint(offset).cast("int")
    x = F.when(F.col("axis") == "x", at).when(F.col("axis") == "y", 0).otherwise(F.rint((F.col("width") - F.col("cw")) / 2).cast("int"))
    y = F.when(F.col("axis") == "y", at).when(F.col("axis") == "x", 0).otherwise(F.rint((F.col("height") - F.col("ch")) / 2).cast("int"))
    return [x.alias("x"), y.alias("y"), F.col("cw").alias("w")]


def window_frames(signals: DataFrame, clips: DataFrame, weights: dict[str, float], width: int, share: float, segments: int, drop: float) -> DataFrame:
    """Frames that the signals choose: entity, start, end (half-open).

    Each signal is brought between its 10th and 90th percentile, the weighted mean of those a sample has is averaged over ``width`` samples, the best windows are taken, and the last ``drop`` of
    the clip goes. A clip of which nothing would stay keeps all but its tail.
    """
    rows = signals.select("entity", "frame")
    for name in weights:
        one = sequence.robust(signals.where(F.col(name).isNotNull()).select("entity", "frame", F.col(name).alias("_v")), "_v").select("entity", "frame", F.col("robust").alias(name))
        rows = rows.join(one, ["entity", "frame"], "left")
    scored = rows.select("entity", "frame", F.coalesce(windows.weighted_mean_score(weights), F.lit(1.0)).alias("score"))
    smooth = scored.select("entity", "frame", F.round(windows.average("score", width), 9).alias("score"))
    cut = selection.greedy_windows(smooth, "score", share, segments, clips)
    last = (F.col("n") - F.rint(drop * F.col("n"))).cast("int")
    r = cut.join(clips.select("entity", "n"), "entity").select("entity", "start", F.least("end", last).alias("end"), last.alias("last"))
    none = F.col("end") - F.col("start") < 1
    return r.select("entity", F.when(none, 0).otherwise(F.col("start")).alias("start"), F.when(none, F.greatest(F.lit(1), F.col("last"))).otherwise(F.col("end")).alias("end"))


def best_subject(dets: DataFrame) -> DataFrame:
    """Of each frame's detections (entity, frame, cx, cy, conf, area, pos) the one that is sure, large and central: entity, frame, cx, cy. Ties: the lowest pos."""
    off = F.sqrt(F.pow(F.col("cx") - 0.5, 2) + F.pow(F.col("cy") - 0.5, 2))
    score = F.col("conf") * F.sqrt(F.greatest(F.col("area"), F.lit(0.0))) * (0.5 + 0.5 * (1 - F.least(F.lit(1.0), off)))
    best = dets.groupBy("entity", "frame").agg(F.min_by(F.struct("cx", "cy"), F.struct((-F.round(score, 9)).alias("s"), "pos")).alias("b"))
    return best.select("entity", "frame", "b.cx", "b.cy")


def subject_arm(signals: DataFrame, dets: DataFrame, clips: DataFrame, weights: dict[str, float], width: int = 5, share: float = 0.5, segments: int = 1, drop: float = 0.08, stride: int = 3, alpha: float = 0.5, ema: float = 0.3) -> DataFrame:
    """Boxes on the chosen frames, following the subject.

    Every ``stride``-th frame of the window and its last one look at the best detection; frames that don't, and keyframes without any, count as the middle. Centres are pulled to the
    middle by ``alpha``, offsets pass a median of three and an exponential average, and are held inside the picture.
    """
    chosen = window_frames(signals, clips, weights, width, share, segments, drop)
    frames = chosen.select("entity", "start", "end", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("frame"))
    key = ((F.col("frame") - F.col("start")) % stride == 0) | (F.col("frame") == F.col("end") - 1)
    r = frames.join(best_subject(dets), ["entity", "frame"], "left").join(clips, "entity")
    seen = F.when(key, F.when(F.col("axis") == "x", F.col("cx")).otherwise(F.col("cy")))
    r = r.withColumn("o", start(shrink(F.coalesce(seen, F.lit(0.5)), alpha))).withColumn("m", sequence.median3(F.col("o")))
    smooth = sequence.ema(r.select("entity", "frame", "m"), "m", ema)
    held = F.greatest(F.lit(0.0), F.least(F.round("ema", 9), travel()))
    return smooth.join(clips, "entity").select("entity", "frame", *placed(held))


def with_head_centers(dets: Column, share: float, only: str = "person") -> Column:
    """An array of detections where those of a class with ``top`` and ``bh`` have their ``cy`` moved to ``share`` of the height below the top, held in 0..1. The others stay."""
    moved = lambda d: d.withField("cy", F.greatest(F.lit(0.0), F.least(F.lit(1.0), d["top"] + share * d["bh"])))
    return F.transform(dets, lambda d: F.when((d["cls"] == only) & d["top"].isNotNull() & d["bh"].isNotNull(), moved(d)).otherwise(d))


def pooled(dets: Column, axis: Column, classes: list[str]) -> Column:
    """Of an array of detections those of some classes: (center, n), their centre on the axis weighted by conf * area, held in 0..1 (null: none), and their number."""

    def of(ds: Column) -> Column:
        weight = lambda d: d["conf"] * F.greatest(d["area"], F.lit(1e-9))
        parts = F.transform(F.filter(ds, lambda d: weight(d) > 0), lambda d: F.struct(weight(d).alias("w"), (weight(d) * F.when(axis == "x", d["cx"]).otherwise(d["cy"])).alias("s")))
        sums = F.aggregate(parts, F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("s")), lambda t, p: F.struct((t["w"] + p["w"]).alias("w"), (t["s"] + p["s"]).alias("s")))
        return let(sums, lambda t: F.struct(F.when(t["w"] > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(t["s"], t["w"])))).alias("center"), F.size(ds).alias("n")))

    return let(F.filter(dets, lambda d: d["cls"].isin(classes)), of)


def subject_series(sampled: DataFrame, pets: DataFrame, heads: DataFrame, clips: DataFrame, animal: DataFrame, head_share: float) -> DataFrame:
    """A row for each sample of an entity's subject: entity, frame, center, n, kind.

    Entities of ``animal`` are read from ``pets`` if they have samples there. The subject is the persons if any sample shows one, else the pets, and of ``animal`` the pets first. Portrait clips with persons are read from ``heads``, if
    persons are seen there. Entities without a subject have no rows. All sources go through one shuffle by entity.
    """
    kinds = {"main": sampled, "pet": pets, "head": heads.withColumn("dets", with_head_centers(F.col("dets"), head_share))}
    rows = None
    for name, df in kinds.items():
        part = df.select("entity", "frame", "dets", F.lit(name).alias("src"))
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.join(clips.select("entity", "axis"), "entity").join(animal.select("entity").distinct().withColumn("animal", F.lit(True)), "entity", "left")
    rows = rows.select("entity", "frame", "src", "axis", F.coalesce("animal", F.lit(False)).alias("animal"), pooled(F.col("dets"), F.col("axis"), ["person"]).alias("p"), pooled(F.col("dets"), F.col("axis"), PETS).alias("t"))
    whole = Window.partitionBy("entity")
    any_of = lambda c: F.coalesce(F.max(c).over(whole), F.lit(False))
    rows = rows.withColumn("own", any_of((F.col("src") == "pet") & F.col("animal")))
    used = F.when(F.col("own"), F.col("src") == "pet").otherwise(F.col("src") == "main")
    rows = rows.withColumn("used", used).withColumn("has_p", any_of(F.col("used") & F.col("p.center").isNotNull())).withColumn("has_t", any_of(F.col("used") & F.col("t.center").isNotNull())).withColumn("has_h", any_of((F.col("src") == "head") & F.col("p.center").isNotNull()))
    kind = F.when(F.col("animal") & F.col("has_t"), "pet").when(F.col("has_p"), "person").when(F.col("has_t"), "pet")
    rows = rows.withColumn("kind", kind).withColumn("face", (F.col("kind") == "person") & (F.col("axis") == "y") & F.col("has_h"))
    rows = rows.where(F.col("kind").isNotNull() & F.when(F.col("face"), F.col("src") == "head").otherwise(F.col("used")))
    of = F.when(F.col("kind") == "pet", F.col("t")).otherwise(F.col("p"))
    return rows.select("entity", "frame", of["center"].alias("center"), of["n"].alias("n"), "kind")


def trace_arm(
    base: DataFrame, clips: DataFrame, sampled: DataFrame, animal: DataFrame, pets: DataFrame, heads: DataFrame, black: DataFrame, threshold: float = 2.0, least_single: float = 0.7,
    width: int = 9, head_share: float = 0.24, dark: tuple[float, float] = (0.8, 60.0), gap: int = 0, least_conf: float = 0.3, most_drop: float = 0.5,
) -> DataFrame:
    """Boxes of ``base`` (entity, frame, x, y, w; centred) with their place overlaid where the subject is trusted: entity, frame, x, y, w, how.

    ``sampled``, ``pets`` and ``heads``: sampled frames with detections (entity, frame, dets) of the main detector, of one tuned to pets, read instead for entities of ``animal``, and of one with whole
    persons, read for portrait clips that show persons. ``black``: brightness samples (entity, frame, mean, dark).
    An entity without a subject, or with more persons a sampled frame than ``threshold``, keeps its base boxes (``base``); pets and portrait persons are exempt from the
    count. One with a single subject in ``least_single`` of its samples, or pets, is traced (``trace``): sample centres, filled linearly, averaged over ``width`` samples, interpolated to
    frames. Others stand at their median (``const``). Frames at the head and tail that are dark without a target are dropped, ``most_drop`` of an entity at most.
    """
    series = subject_series(sampled, pets, heads, clips, animal, head_share)
    facts = series.groupBy("entity").agg(F.first("kind").alias("kind"), F.avg("n").alias("clutter"), F.avg((F.col("n") == 1).cast("int")).alias("single"), F.percentile("center", F.lit(0.5)).alias("median"))
    facts = clips.join(facts, "entity", "left").withColumn("exempt", (F.col("kind") == "pet") | ((F.col("axis") == "y") & (F.col("kind") == "person")))
    gated = F.col("kind").isNull() | (F.col("axis") == "none") | (~F.col("exempt") & (F.col("clutter") > threshold))
    how = F.when(gated, "base").when((F.col("kind") == "pet") | (F.col("single") >= least_single), "trace").otherwise("const")
    facts = facts.withColumn("how", how)

    samples = series.join(facts.where("how = 'trace'").select("entity"), "entity", "left_semi")
    by = Window.partitionBy("entity").orderBy("frame")
    numbered = samples.select("entity", (F.row_number().over(by) - 1).alias("i"), F.col("frame").alias("at"), "center")
    filled = sequence.interpolate(numbered.where("center IS NOT NULL").select("entity", F.col("i").alias("frame"), F.col("center").alias("y")), numbered.groupBy("entity").agg(F.count(F.lit(1)).alias("n"))).select("entity", F.col("frame").alias("i"), F.col("linear").alias("c"))
    smooth = numbered.join(filled, ["entity", "i"]).select("entity", F.col("at").alias("frame"), "c").select("entity", "frame", windows.smooth("c", width).alias("c"))
    # frames and samples on one line, each frame between its neighbours
    both = base.select("entity", "frame").join(facts.where("how = 'trace'").select("entity"), "entity", "left_semi").withColumn("wanted", F.lit(True)).join(smooth, ["entity", "frame"], "full_outer")
    back, ahead = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col("c").isNotNull(), F.col("frame"))
    near = both.select("entity", "frame", "wanted", F.last("c", True).over(back).alias("a"), F.last(known, True).over(back).alias("fa"), F.first("c", True).over(ahead).alias("b"), F.first(known, True).over(ahead).alias("fb")).where("wanted")
    line = F.when(F.col("a").isNull(), F.col("b")).when(F.col("b").isNull() | (F.col("fa") == F.col("fb")), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.try_divide(F.col("frame") - F.col("fa"), F.col("fb") - F.col("fa")))
    traced = near.select("entity", "frame", line.alias("moving"))

    r = base.join(facts.select("entity", "width", "height", "cw", "ch", "axis", "how", "median"), "entity").join(traced, ["entity", "frame"], "left")
    center = F.round(F.when(F.col("how") == "trace", F.col("moving")).otherwise(F.col("median")), 9)
    x, y, _ = placed(start(center))
    r = r.select("entity", "frame", F.when(F.col("how") == "base", F.col("x")).otherwise(x).alias("x"), F.when(F.col("how") == "base", F.col("y")).otherwise(y).alias("y"), "w", "how")

    sure = lambda names: (lambda d: d["cls"].isin(names) & (d["conf"] >= least_conf))
    targets = sampled.where(F.exists("dets", sure(["person", *PETS]))).select("entity", "frame").unionByName(pets.where(F.exists("dets", sure(PETS))).select("entity", "frame"))
    slates = gates.slates(black, targets, *dark)
    return r.join(gates.slate_drop(base.select("entity", "frame"), slates, gap, most_drop), ["entity", "frame"], "left_semi")


def reassembled(spatial: DataFrame, temporal: DataFrame) -> DataFrame:
    """Records of ``spatial`` (video_id, targetRatioWH, model_size_mb, predictions), with the predictions of ``temporal`` where it has the video."""
    out = pool.overlay(spatial, temporal.select("video_id", "predictions"), "video_id", "predictions")
    return out.withColumnRenamed("patched", "swapped")


def clutter_study(frames: DataFrame, clips: DataFrame, truth: DataFrame, cuts: list[float], softness: list[float], score_const) -> DataFrame:
    """Mean F1 of constants at the median behind a hard gate at each clutter cut, and pulled to the middle by exp(-clutter / K) for each K: rule, value, f1.

    ``frames``: pooled centres with counts (entity, frame, center, n); ``score_const`` scores (entity, by, c) against ``truth`` on ``clips``.
    """
    e = frames.groupBy("entity").agg(F.percentile("center", F.lit(0.5)).alias("m"), F.avg("n").alias("clutter"))
    e = clips.select("entity").join(e, "entity", "left")
    hard = [(F.struct(F.lit("hard").alias("rule"), F.lit(float(c)).alias("value")), F.when(F.col("m").isNull() | (F.col("clutter") > c), 0.5).otherwise(F.col("m"))) for c in cuts]
    soft = [(F.struct(F.lit("soft").alias("rule"), F.lit(float(k)).alias("value")), F.coalesce(0.5 + (F.col("m") - 0.5) * F.exp(-F.col("clutter") / k), F.lit(0.5))) for k in softness]
    rows = e.select("entity", F.explode(F.array(*(F.struct(by.alias("by"), c.alias("c")) for by, c in hard + soft))).alias("r")).select("entity", "r.by", "r.c")
    return score_const(rows, clips, truth).select("by.rule", "by.value", "f1")
