"""Windows, fits and rules against plain definitions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelark.operators import arms, experiments, selection


def greedy(values, n, share, segments):
    m = len(values)
    budget = max(1, min(n, round(share * n)))
    if not m:
        return 0, budget, 0
    length = min(m, max(1, round(budget * m / max(1, n))))
    means = [round(sum(values[i : i + length]) / length, 9) for i in range(m - length + 1)]
    picks = []
    for i in sorted(range(len(means)), key=lambda i: (-means[i], i)):
        if all(abs(i - p) >= length for p in picks):
            picks.append(i)
            if len(picks) == segments:
                break
    if len(picks) > 1 and means[picks[1]] < 0.8 * means[picks[0]]:
        picks = picks[:1]
    a = max(0, min(n - 1, round(min(picks) * n / m)))
    b = round((max(picks) + length) * n / m)
    return a, max(a + 1, min(n, b)), len(picks)


@pytest.mark.parametrize("segments", [1, 2, 4])
def test_greedy_windows(spark, segments):
    rng = random.Random(segments)
    series = {e: [float(rng.randint(0, 5)) for _ in range(rng.randint(1, 30))] for e in range(40)}
    frames = {e: len(v) * 3 + e % 2 for e, v in series.items()} | {99: 17}
    df = spark.createDataFrame([(e, i, v) for e, vs in series.items() for i, v in enumerate(vs)], "entity int, frame int, v double")
    clips = spark.createDataFrame(list(frames.items()), "entity int, n int")
    got = {r.entity: (r.start, r.end, r.windows) for r in selection.greedy_windows(df, "v", 0.2, segments, clips).collect()}
    assert got == {e: greedy(series.get(e, []), n, 0.2, segments) for e, n in frames.items()}


def test_fixture_window(spark):
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([1, 4, 4, 1, 1, 4, 4])], "entity int, frame int, v double")
    (r,) = selection.greedy_windows(df, "v", 0.3, 1, spark.createDataFrame([(1, 7)], "entity int, n int")).collect()
    assert (r.start, r.end) == (1, 3)
    with pytest.raises(ValueError):
        selection.greedy_windows(df, "v", 0.3, 0, df)


def test_selectors(spark):
    rng = random.Random(3)
    n = 60
    rows = [(1, f, float(rng.randint(0, 9)), float(f % 5), float(rng.randint(0, 3))) for f in range(n)] + [(2, f, 1.0, 1.0, 1.0) for f in range(5)]
    series = spark.createDataFrame(rows, "entity int, frame int, audio double, motion double, person double")
    grid = series.where("frame < 55")
    iv = spark.createDataFrame([(1, 20, 30), (2, 40, 50)], "entity int, start int, end int")
    got: dict = {}
    for r in selection.selected(series, grid, iv).collect():
        got.setdefault((r.name, r.entity), []).append(r.frame)
    assert len({k for k, _ in got}) == 16 and all(len(v) == len(set(v)) and set(v) <= set(range(55)) for v in got.values())
    assert sorted(got["keep_all", 1]) == list(range(55))
    assert sorted(got["position_0.16_0.88", 1]) == [f for f in range(55) if 0.16 * n <= f < 0.88 * n]
    assert sorted(got["vlm_1.5", 1]) == [f for f in range(55) if 17.5 <= f < 32.5]
    assert sorted(got["vlm_1.0", 2]) == list(range(5))  # an empty selection keeps all
    assert len(got["top_comb_0.6", 1]) == 33 and len(got["window_comb_0.5", 1]) == round(0.5 * 55)
    assert max(got["window_audio_0.6", 1]) - min(got["window_audio_0.6", 1]) == 32
    assert sorted(got["window_comb_0.6", 2]) == [0, 1, 2]
    with pytest.raises(ValueError):
        selection.selected(series, grid, iv, [selection.Experiment("x", "unknown")])


@pytest.mark.parametrize("k", [0, 1, 3, 6])
def test_linear_fit_leaves_each_row_out(spark, k):
    rng = np.random.default_rng(k)
    x = rng.normal(5, 1, (30, k))
    if k == 6:
        x[:, 5] = x[:, 0] * 2  # a feature that says nothing new
    y = x.sum(1) + rng.normal(0, 1, 30)
    names = [f"f{i}" for i in range(k)]
    df = spark.createDataFrame([(i, float(y[i]), *map(float, x[i])) for i in range(30)] + [(30, None, *[1.0] * k)], "entity int, y double" + "".join(f", {n} double" for n in names))
    got = {r.entity: (r.fitted, r.left_out) for r in experiments.linear_fit(df, "y", names).collect()}
    a = np.c_[np.ones(30), x]
    whole = a @ np.linalg.lstsq(a, y, rcond=None)[0]
    for i in range(30):
        m = np.arange(30) != i
        want = a[i] @ np.linalg.lstsq(a[m], y[m], rcond=None)[0]
        assert got[i] == pytest.approx((whole[i], want), abs=1e-8)
    assert got[30] == (None, None)
    assert experiments.linear_fit(df.limit(0), "y", names).collect() == []
    with pytest.raises(ValueError):
        experiments.linear_fit(df, "y", ["a"] * 7)


def test_marginal_inclusion_settles(spark):
    # ten clips of 50 frames; hits in the first 40 places of half of them, in none of the rest
    rows = [(e, f, e < 5 and f < 40) for e in range(10) for f in range(50)]
    df = spark.createDataFrame(rows, "entity int, frame int, hit boolean")
    got = experiments.marginal_inclusion(df, F.col("hit"), 0.7).collect()
    assert [r.n_bins for r in got] == [50, 40, 40][: len(got)] and got[-1].settled and got[-1].n_kept == 400
    assert got[0].f1 == pytest.approx(1.4 * 200 / 700) and got[-1].f1 == pytest.approx(1.4 * 200 / 600)
    assert experiments.marginal_inclusion(df.limit(0), F.col("hit"), 0.7).collect() == []
    with pytest.raises(ValueError):
        experiments.marginal_inclusion(df, F.col("hit"), 0.0)


def test_noise_only_hurts(spark):
    truth = spark.createDataFrame([(e, f, float(10 * e), 0.0, 50.0, 100.0) for e in range(30) for f in range(10)], "entity int, frame int, x double, y double, w double, h double")
    clips = spark.createDataFrame([(e, 10, 400.0, 50.0, 100.0) for e in range(31)], "entity int, n int, width double, crop double, h double")
    clutter = spark.createDataFrame([(e, 3.0 if e == 0 else 1.0) for e in range(30)], "entity int, clutter double")
    got = experiments.noise_curve(truth, clips, clutter, [0.0, 0.05, 0.5]).orderBy("sigma").collect()
    assert [r.sigma for r in got] == [0.0, 0.05, 0.5]
    assert got[0].const == pytest.approx(18 / 19) and got[0].traj == pytest.approx(18 / 19)
    assert got[0].const > got[1].const > got[2].const and got[0].gated < got[0].const


def test_normal_draws(spark):
    (r,) = spark.range(20_000).select(experiments.normal(F.col("id")).alias("z")).agg(F.avg("z").alias("m"), F.stddev("z").alias("s"), F.avg((F.abs("z") < 1.96).cast("int")).alias("inside")).collect()
    assert abs(r.m) < 0.03 and abs(r.s - 1) < 0.03 and abs(r.inside - 0.95) < 0.01


def test_heads(spark):
    kind = "array<struct<cls: string, cy: double, top: double, bh: double>>"
    df = spark.createDataFrame([([("person", 0.5, 0.1, 0.5), ("person", 0.5, None, 0.5), ("dog", 0.5, 0.1, 0.5), ("person", 0.5, 0.95, 0.5), ("person", 0.5, -1.0, 0.5)],), ([],), (None,)], f"dets {kind}")
    got = [r.d and [round(x.cy, 6) for x in r.d] for r in df.select(arms.with_head_centers(F.col("dets"), 0.2).alias("d")).collect()]
    assert got == [[0.2, 0.5, 0.5, 1.0, 0.0], [], None]


def test_selection_brings_series_together_once(spark, capsys):
    df = spark.createDataFrame([(e, f, float(f % 7)) for e in range(3) for f in range(20)], "entity int, frame int, audio double")
    iv = spark.createDataFrame([(1, 2, 9)], "entity int, start int, end int")
    # a window longer than its series is the whole series
    long = selection.Experiment("long", "best_window", share=1.5, weights={"audio": 1.0})
    assert selection.selected(df, df, iv, [long]).count() == 60
    selection.selected(df, df, iv).explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange") <= 14 and "BroadcastHashJoin" not in plan
