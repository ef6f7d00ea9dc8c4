"""Threshold windows against a plain search, and the exponential average against a loop."""

import numpy as np

from framelark.operators import windows


def plain(values, share, k, gap):
    n, (lo, hi), best = len(values), (min(values), max(values)), None
    for _ in range(40):
        th = (lo + hi) / 2
        runs = []
        for i in range(n):
            if values[i] >= th:
                if runs and i - runs[-1][1] <= gap:
                    runs[-1][1] = i
                else:
                    runs.append([i, i])
        chosen = sorted(runs, key=lambda r: (r[1] - r[0], r[0]))[-k:]
        keep = [i for i in range(n) if any(a <= i <= b for a, b in chosen)]
        if best is None or abs(len(keep) - round(share * n)) < abs(len(best) - round(share * n)):
            best = keep
        lo, hi = (th, hi) if len(keep) > round(share * n) else (lo, th)
    return best


def test_threshold_windows(spark):
    r = np.random.default_rng(2)
    series = {e: [round(float(x), 3) for x in r.random(int(r.integers(5, 60)))] for e in range(12)}
    rows = [(e, i, v) for e, vs in series.items() for i, v in enumerate(vs)]
    got = {}
    for x in windows.threshold_windows(spark.createDataFrame(rows, "entity int, frame int, v double"), "v", 0.4, 2, 3).collect():
        got.setdefault(x.entity, []).append(x.frame)
    assert {e: sorted(f) for e, f in got.items()} == {e: plain(vs, 0.4, 2, 3) for e, vs in series.items()}
