"""Which frames of a series to keep: experiments as data, all over one shared scan, and windows chosen greedily."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import iou
from . import score
from .sequence import by_frame, minmax, whole, zscore
from .windows import nearest_runs


@dataclass(frozen=True)
class Experiment:
    """A selector with its settings; ``weights`` are those of the signals in its score."""

    name: str
    selector: str
    share: float = 1.0
    lo: float = 0.0
    hi: float = 1.0
    k: int = 1
    widen: float = 1.0
    weights: dict[str, float] = field(default_factory=dict)


_ALL = {"audio": 1.0, "motion": 1.0, "person": 1.0}
#: Names and settings of the sixteen experiments.
EXPERIMENTS = (
    Experiment("keep_all", "keep_all"),
    Experiment("position_0.16_0.88", "position_window", lo=0.16, hi=0.88),
    Experiment("window_audio_0.6", "best_window", share=0.6, weights={"audio": 1.0}),
    Experiment("window_audio_0.5", "best_window", share=0.5, weights={"audio": 1.0}),
    Experiment("window_motion_0.6", "best_window", share=0.6, weights={"motion": 1.0}),
    Experiment("window_person_0.6", "best_window", share=0.6, weights={"person": 1.0}),
    Experiment("window_comb_0.5", "best_window", share=0.5, weights=_ALL),
    Experiment("window_comb_0.6", "best_window", share=0.6, weights=_ALL),
    Experiment("window_comb_0.7", "best_window", share=0.7, weights=_ALL),
    Experiment("window_audioMotion_0.6", "best_window", share=0.6, weights={"audio": 1.0, "motion": 1.0}),
    Experiment("top_comb_0.6", "top_fraction", share=0.6, weights=_ALL),
    Experiment("multi_comb_0.6_k2", "threshold_windows", share=0.6, k=2, weights=_ALL),
    Experiment("multi_comb_0.7_k3", "threshold_windows", share=0.7, k=3, weights=_ALL),
    Experiment("vlm_1.0", "interval", widen=1.0),
    Experiment("vlm_1.25", "interval", widen=1.25),
    Experiment("vlm_1.5", "interval", widen=1.5),
)
MERGE_GAP = 15
SELECTORS = {"keep_all", "position_window", "drop_tail", "best_window", "top_fraction", "interval", "threshold_windows"}


def _weights(e: Experiment, there: list[str]) -> tuple[float, ...]:
    return tuple(float(e.weights.get(k, 0.0)) for k in there)


def scored(series: DataFrame, grid: DataFrame, experiments) -> tuple[DataFrame, list[str]]:
    """A row for each frame of ``grid`` (entity, frame and any columns that stay): n_frames and one score for each set of weights; the name of each experiment's score.

    Signals of ``series`` (entity, frame, signals) are brought to 0..1 and then to deviations over the whole series, once for all experiments; signals it lacks are left out.
    """
    names = sorted({k for e in experiments for k in e.weights if k in series.columns})
    z = series.select("entity", "frame", F.count(F.lit(1)).over(whole()).alias("n_frames"), *(minmax(F.col(k)).alias(k) for k in names))
    z = z.select("entity", "frame", "n_frames", *(zscore(F.col(k)).alias(k) for k in names))
    # frames pack so well that Spark would take them for small enough to broadcast
    z = z.join(grid.hint("merge"), ["entity", "frame"], "left_semi" if set(grid.columns) == {"entity", "frame"} else "inner")
    sets = list(dict.fromkeys(_weights(e, names) for e in experiments))
    total = lambda ws: sum((F.lit(w) * F.col(k) for k, w in zip(names, ws, strict=True)), F.lit(0.0))
    stay = [c for c in grid.columns if c not in ("entity", "frame")]
    rows = z.select("entity", "frame", *stay, "n_frames", *(F.round(total(ws), 9).alias(f"v{i}") for i, ws in enumerate(sets)))
    return rows, [f"v{sets.index(_weights(e, names))}" for e in experiments]


def _length(e: Experiment) -> Column:
    return F.least(F.col("n"), F.greatest(F.lit(1), F.rint(F.lit(float(e.share)) * F.col("n")))).cast("int")


def _first_of_best(e: Experiment, v: str) -> Column:
    """Where (from 0) the window of round(share * n) frames with the largest sum begins, the first of equals; ``a``: the series' frames in order, with running sums."""
    total = lambda i: F.round(F.get("a", i + _length(e) - 1)[f"s{v}"] - F.get("a", i)[f"s{v}"] + F.get("a", i)[v], 6)
    all_windows = F.transform(F.sequence(F.lit(0), F.col("n") - _length(e)), lambda i: F.struct(total(i).alias("total"), (-i).alias("back")))
    return -F.array_max(all_windows)["back"]


def _never_empty(keep: Column) -> Column:
    keep = F.coalesce(keep, F.lit(False))
    return keep | ~F.max(keep).over(whole())


def _keep(i: int, e: Experiment, v: str) -> Column:
    """Whether experiment ``i`` keeps a frame; ``at``: its place in the series, from 0."""
    match e.selector:
        case "keep_all":
            return F.lit(True)
        case "position_window":
            return _never_empty((F.col("frame") >= e.lo * F.col("n_frames")) & (F.col("frame") < e.hi * F.col("n_frames")))
        case "drop_tail":
            return _never_empty(F.col("frame") < F.rint(e.hi * F.col("n_frames")))
        case "best_window":
            return (F.col("at") >= F.col(f"first{i}")) & (F.col("at") < F.col(f"first{i}") + _length(e))
        case "top_fraction":
            return F.row_number().over(whole().orderBy(F.col(v).desc(), "frame")) <= _length(e)
        case "interval":
            # half-open, widened about its middle; all where there is none
            middle, half = (F.col("from") + F.col("to")) / 2, (F.col("to") - F.col("from")) / 2 * e.widen
            inside = (F.col("frame") >= middle - half) & (F.col("frame") < middle + half)
            return _never_empty(F.when(F.col("to") > F.col("from"), inside).otherwise(True))
    raise ValueError(f"no selector {e.selector}")


def _by_columns(rows: DataFrame, stay: list[str], intervals: DataFrame, experiments: list[tuple[Experiment, str]]) -> DataFrame:
    """The frames that these experiments keep. A series is brought together once; its frames carry a flag for each experiment and only those kept are multiplied."""
    vs = sorted({v for _, v in experiments})
    sums = sorted({v for e, v in experiments if e.selector == "best_window"})
    r = rows.select("entity", "frame", *stay, "n_frames", *vs, *(F.sum(v).over(by_frame()).alias(f"s{v}") for v in sums))
    lists = r.groupBy("entity").agg(F.sort_array(F.collect_list(F.struct(*(c for c in r.columns if c != "entity")))).alias("a")).withColumn("n", F.size("a"))
    if any(e.selector == "interval" for e, _ in experiments):
        lists = lists.join(intervals.select("entity", F.col("start").alias("from"), F.col("end").alias("to")).hint("merge"), "entity", "left")
    lists = lists.select("*", *(_first_of_best(e, v).alias(f"first{i}") for i, (e, v) in enumerate(experiments) if e.selector == "best_window"))
    frames = lists.select(*(c for c in lists.columns if c != "a"), F.posexplode("a").alias("at", "r")).select("*", "r.*").drop("r")
    kept = frames.select("entity", "frame", *stay, F.array_compact(F.array(*(F.when(_keep(i, e, v), F.lit(e.name)) for i, (e, v) in enumerate(experiments)))).alias("names"))
    return kept.select(F.explode("names").alias("name"), "entity", "frame", *stay)


def _by_runs(rows: DataFrame, stay: list[str], experiments: list[tuple[Experiment, str]]) -> DataFrame:
    """The frames that thresholds keep: all these experiments in one visit of a series, which has to be there at once."""
    kinds, settings = dict(rows.dtypes), [(e.name, v, e.share, e.k) for e, v in experiments]
    columns = ["entity", "frame", *stay]

    def one(pdf):
        pdf = pdf.sort_values("frame")
        out = []
        for name, v, share, k in settings:
            keep = nearest_runs(pdf["frame"].to_numpy(), pdf[v].to_numpy(float), share, k, MERGE_GAP)
            out.append((pdf[keep] if keep.any() else pdf)[columns].assign(name=name))
        return pd.concat(out)[["name", *columns]]

    used = rows.select(*columns, *sorted({v for _, v in experiments}))
    return used.groupBy("entity").applyInPandas(one, ", ".join(["name string", *(f"`{c}` {kinds[c]}" for c in columns)]))


def _kept(series: DataFrame, grid: DataFrame, intervals: DataFrame, experiments) -> DataFrame:
    """name, entity, frame and the other columns of ``grid`` for the frames that each experiment keeps."""
    experiments = list(experiments)
    if wrong := sorted({e.selector for e in experiments} - SELECTORS):
        raise ValueError(f"no selector {wrong}")
    stay = [c for c in grid.columns if c not in ("entity", "frame")]
    rows, scores = scored(series, grid, experiments)
    # a number of its own: rows pack so well that Spark would put all series into one task
    rows = rows.repartition(max(32, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "entity")
    each = list(zip(experiments, scores, strict=True))
    runs = [x for x in each if x[0].selector == "threshold_windows"]
    rest = [x for x in each if x[0].selector != "threshold_windows"]
    parts = ([_by_columns(rows, stay, intervals, rest)] if rest else []) + ([_by_runs(rows, stay, runs)] if runs else [])
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def selected(series: DataFrame, grid: DataFrame, intervals: DataFrame, experiments=EXPERIMENTS) -> DataFrame:
    """name, entity, frame: the frames of ``grid`` that each experiment keeps. A selection that would be empty keeps all; none adds a frame.

    ``intervals`` (entity, start, end) has one row an entity at most.
    """
    return _kept(series, grid.select("entity", "frame"), intervals, experiments)


def ranked(series: DataFrame, base: DataFrame, truth: DataFrame, intervals: DataFrame, experiments=EXPERIMENTS) -> DataFrame:
    """For each experiment: F1 (mean over entities of ``truth``), keep_ratio and n_pred of the boxes of ``base`` on the frames it keeps.

    ``base`` and ``truth`` have one row a frame. A box's overlap doesn't depend on the experiment, so boxes meet the truth once, before frames are selected.
    """
    box = lambda df, name: df.select("entity", "frame", F.struct(*score.BOX).alias(name))
    overlap = F.when(F.col("t").isNotNull(), iou(*(F.col(f"{s}.{c}") for s in "pt" for c in score.BOX)))
    boxes = box(base, "p").join(box(truth, "t").hint("merge"), ["entity", "frame"], "left").select("entity", "frame", overlap.alias("iou"))
    each = _kept(series, boxes, intervals, experiments).groupBy("name", "entity").agg(F.count(F.lit(1)).alias("n_pred"), F.coalesce(F.sum("iou"), F.lit(0.0)).alias("s"))
    real = truth.groupBy("entity").agg(F.count(F.lit(1)).alias("n_truth"))
    f1 = 2 * F.col("s") / (F.col("n_pred") + F.col("n_truth"))  # 0 for the entities of the truth without boxes
    sums = each.join(real.hint("merge"), "entity", "left").groupBy("name").agg(F.sum("n_pred").alias("n_pred"), F.coalesce(F.sum(f1), F.lit(0.0)).alias("f"))
    # one row each
    total, entities = base.agg(F.count(F.lit(1)).alias("n_base")), real.agg(F.count(F.lit(1)).alias("n_entities"))
    out = sums.join(F.broadcast(total)).join(F.broadcast(entities))
    return out.select("name", F.try_divide("f", "n_entities").alias("F1"), (F.col("n_pred") / F.col("n_base")).alias("keep_ratio"), "n_pred")


def greedy_windows(series: DataFrame, name: str, share: float, segments: int, clips: DataFrame) -> DataFrame:
    """Per clip (entity, n: its frames) the hull of up to ``segments`` windows of samples that don't overlap, as half-open frames: start, end, windows.

    A window has the samples of round(share * n) frames. The window with the largest mean is taken first (ties: the earlier one), then the best of those apart from all taken
    so far. If the second is weaker than 0.8 of the first, the first stands alone. Samples are scaled to frames. A clip without samples keeps its first round(share * n) frames.
    """
    if segments < 1:
        raise ValueError("at least one window")
    budget = F.greatest(F.lit(1), F.least(F.col("n"), F.rint(share * F.col("n")))).cast("int")
    i, m = F.row_number().over(by_frame()) - 1, F.count(F.lit(1)).over(whole())
    rows = series.select("entity", i.alias("i"), m.cast("int").alias("m"), F.sum(name).over(by_frame()).alias("s"), F.col(name).alias("v"))
    sizes = clips.select("entity", F.col("n").cast("int").alias("n"), budget.alias("budget"))
    rows = rows.join(sizes, "entity").withColumn("len", F.least(F.col("m"), F.greatest(F.lit(1), F.rint(F.col("budget") * F.col("m") / F.greatest(F.lit(1), F.col("n"))))).cast("int"))
    ends = rows.select("entity", (F.col("i") - F.col("len") + 1).alias("i"), F.col("s").alias("e"))
    means = rows.join(ends, ["entity", "i"]).select("entity", "i", "m", "n", "len", F.round((F.col("e") - F.col("s") + F.col("v")) / F.col("len"), 9).alias("mean"))
    pick = F.max(F.struct("mean", (-F.col("i")).alias("back"), "len", "m", "n")).alias("p")
    taken = means.groupBy("entity").agg(pick).select("entity", F.array((-F.col("p.back")).cast("int")).alias("at"), F.array("p.mean").alias("means"), "p.len", "p.m", "p.n")
    for _ in range(segments - 1):
        free = means.select("entity", "i", "mean").join(taken, "entity").where(F.forall("at", lambda a: F.abs(F.col("i") - a) >= F.col("len")))
        best = free.groupBy("entity").agg(F.max(F.struct("mean", (-F.col("i")).alias("back"))).alias("b"))
        more = lambda xs, x: F.when(F.col("b").isNull(), F.col(xs)).otherwise(F.concat(xs, F.array(x)))
        taken = taken.join(best, "entity", "left").select("entity", more("at", (-F.col("b.back")).cast("int")).alias("at"), more("means", F.col("b.mean")).alias("means"), "len", "m", "n")
    alone = (F.size("at") > 1) & (F.get("means", F.lit(1)) < 0.8 * F.get("means", F.lit(0)))
    chosen = taken.withColumn("at", F.when(alone, F.slice("at", 1, 1)).otherwise(F.col("at")))
    scaled = lambda p: F.rint(p * F.col("n") / F.col("m")).cast("int")
    a = F.greatest(F.lit(0), F.least(F.col("n") - 1, scaled(F.array_min("at"))))
    b = scaled(F.array_max("at") + F.col("len"))
    out = chosen.select("entity", a.alias("start"), F.greatest(a + 1, F.least(F.col("n"), b)).alias("end"), F.size("at").alias("windows"))
    return sizes.join(out, "entity", "left").select("entity", F.coalesce("start", F.lit(0)).alias("start"), F.coalesce("end", "budget").alias("end"), F.coalesce("windows", F.lit(0)).alias("windows"))
