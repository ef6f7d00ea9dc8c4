"""Queries of experiments, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pool, trials
from ..sources import frames as src
from ._base import DETS, SIGNAL, rounded, rounded_even


def _pairs(s, d):
    """Per order: a truth and an estimate of its centre."""
    return src.table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("entity")).agg((F.avg(F.col("l_partkey") % 1000) / 1000).alias("g"), (F.avg(F.col("l_partkey") % 500 + F.col("l_suppkey") % 100) / 600).alias("y"), (F.avg("l_quantity") / 50).alias("q"), F.count(F.lit(1)).cast("double").alias("n"))


def _delta(s, d):
    return _pairs(s, d).withColumn("delta", F.abs(F.col("g") - 0.5) - F.abs(F.col("g") - F.col("y")))


def _grid(s, d):
    r = trials.over_grid(_pairs(s, d), "beta", [0.25, 0.5, 0.75, 1.0])
    return r.withColumn("gain", F.abs(F.col("g") - 0.5) - F.abs(F.col("g") - (0.5 + F.col("beta") * (F.col("y") - 0.5))))


def _bins(df, value):
    return df.withColumn("bin", F.least(F.lit(4), F.floor(F.col(value) * 5)).cast("int"))


QUERIES = {
    "jn17_grid": lambda s, d: rounded_even(_grid(s, d).select("entity", "beta", "gain")),
    "xp2_correlation": lambda s, d: rounded(src.detections(s, d).groupBy("entity").agg(F.corr("c", "area").alias("r"), F.abs(F.corr("c", "area")).alias("abs_r"))),
    "xp3_residual_sd": lambda s, d: rounded(_pairs(s, d).agg(F.regr_slope("g", "y").alias("beta"), F.stddev_samp("g").alias("sd"), F.sqrt(F.var_samp("g") - F.pow(F.covar_samp("g", "y"), 2) / F.var_samp("y")).alias("residual_sd"))),
    "xp4_displacement": lambda s, d: rounded(trials.displacement(src.signal(s, d), "value")),
    "xp6_held_out_slope": lambda s, d: rounded(trials.held_out_slope(_pairs(s, d), "g", "y", 20)),
    "xp6_summary": lambda s, d: rounded(trials.summary(trials.held_out_slope(_pairs(s, d), "g", "y", 20), "gain")),
    "xp7_bootstrap": lambda s, d: rounded(trials.bootstrap(_delta(s, d).select("entity", "delta"), "delta", 100)),
    "xp8_picked_on_half": lambda s, d: rounded(trials.picked_on_half(_grid(s, d), "beta", "gain", 20)),
    "xp9_held_out_curve": lambda s, d: rounded(trials.halves(_delta(s, d), 20).where("NOT train").groupBy("split").agg(F.avg("delta").alias("mean"), F.count(F.lit(1)).alias("n"))),
    "xp10_grid_curve": lambda s, d: rounded(trials.grid_curve(_grid(s, d), "beta", "gain")),
    "xp11_leave_one_out": lambda s, d: rounded(trials.two_feature_fit(_pairs(s, d).withColumn("t", F.col("g") + F.col("q")), "t", "q", "n").select("entity", "fitted")),
    "xp11_fit_quality": lambda s, d: rounded(trials.fit_quality(trials.two_feature_fit(src.table(s, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 17).cast("double").alias("a"), (F.col("s_suppkey") % 5).cast("double").alias("b"), (F.col("s_acctbal") / 1000).alias("t")), "t", "a", "b"), "t")),
    "xp12_features": lambda s, d: rounded(trials.features(src.signal(s, d), "value")),
    "xp17_transfer": lambda s, d: rounded(trials.transfer(_bins(_delta(s, d), "q").groupBy("bin").agg(F.avg("delta").alias("delta")), _bins(_pairs(s, d), "y").groupBy("bin").agg(F.count(F.lit(1)).alias("n")))),
    "xp18_agreement": lambda s, d: rounded(trials.agreement(_pairs(s, d), F.col("g"), F.col("y"))),
    "xp20_paired_centers": lambda s, d: rounded(pool.pool_frames(src.detections(s, d).where("cls = 'R'")).select("entity", "frame", F.col("center").alias("a")).join(pool.pool_frames(src.detections(s, d).where("cls = 'A'")).select("entity", "frame", F.col("center").alias("b")), ["entity", "frame"]).groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.percentile("a", F.lit(0.5)).alias("a"), F.percentile("b", F.lit(0.5)).alias("b"), F.corr("a", "b").alias("r"))),
    "xp21_profile": lambda s, d: rounded(trials.profile(src.signal(s, d).select("entity", "frame"))),
}

_PAIRS = "pairs AS (SELECT l_orderkey AS entity, avg(l_partkey % 1000) / 1000 AS g, avg(l_partkey % 500 + l_suppkey % 100) / 600 AS y, avg(l_quantity) / 50 AS q, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1)"
_DELTA = f"{_PAIRS}, dl AS (SELECT *, abs(g - 0.5) - abs(g - y) AS delta FROM pairs)"
_GRID = f"{_PAIRS}, grid AS (SELECT *, abs(g - 0.5) - abs(g - (0.5 + beta * (y - 0.5))) AS gain FROM pairs, (SELECT unnest([0.25, 0.5, 0.75, 1.0])::DOUBLE AS beta))"
_DRAW = "('0x' || substr(md5({}::VARCHAR || ':' || {}::VARCHAR), 1, 8))::BIGINT"
_SPLITS = f"(SELECT *, {_DRAW.format('split', 'entity')} % 2 = 0 AS train FROM {{}}, (SELECT unnest(range(20)) AS split))"
_SLOPES = f"h AS {_SPLITS.format('pairs')}, f AS (SELECT split, regr_slope(g, y) AS beta FROM h WHERE train GROUP BY 1), gains AS (SELECT split, any_value(beta) AS beta, avg(abs(g - 0.5) - abs(g - (0.5 + beta * (y - 0.5)))) AS gain FROM h JOIN f USING (split) WHERE NOT train GROUP BY split)"
_POISSON = " + ".join(f"(u >= {p})::INT" for p in (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183))


def _fit(rows: str, a: str, b: str, y: str) -> str:
    return f"""m AS (SELECT count(*)::DOUBLE AS mn, avg({a}) AS ma, avg({b}) AS mb, avg({y}) AS my, var_pop({a}) AS saa, var_pop({b}) AS sbb, covar_pop({a}, {b}) AS sab, covar_pop({a}, {y}) AS say, covar_pop({b}, {y}) AS sby FROM {rows}),
        fit AS (SELECT *, my + (say * sbb - sby * sab) / (saa * sbb - sab * sab) * ({a} - ma) + (sby * saa - say * sab) / (saa * sbb - sab * sab) * ({b} - mb) AS fitted,
                (1 + (({a} - ma) ** 2 * sbb - 2 * ({a} - ma) * ({b} - mb) * sab + ({b} - mb) ** 2 * saa) / (saa * sbb - sab * sab)) / mn AS lev FROM {rows}, m)"""


ORACLE_SQL = {
    "jn17_grid": f"WITH {_GRID} SELECT entity, beta, round_even(gain * 1e6, 0) / 1e6 AS gain FROM grid",
    "xp2_correlation": f"WITH {DETS} SELECT entity, round(corr(c, area), 6) AS r, round(abs(corr(c, area)), 6) AS abs_r FROM dets GROUP BY entity",
    "xp3_residual_sd": f"WITH {_PAIRS} SELECT round(regr_slope(g, y), 6) AS beta, round(stddev_samp(g), 6) AS sd, round(sqrt(var_samp(g) - covar_samp(g, y) ** 2 / var_samp(y)), 6) AS residual_sd FROM pairs",
    "xp4_displacement": f"WITH {SIGNAL}, e AS (SELECT quantile_cont(value, 0.5) AS m, stddev_pop(value) AS sd FROM s GROUP BY entity HAVING count(*) >= 3) SELECT count(*) AS n, round(stddev_pop(m), 6) AS bias_sd, round(avg(sd), 6) AS jitter_sd FROM e",
    "xp6_held_out_slope": f"WITH {_PAIRS}, {_SLOPES} SELECT split, round(beta, 6) AS beta, round(gain, 6) AS gain FROM gains",
    "xp6_summary": f"WITH {_PAIRS}, {_SLOPES} SELECT count(*) AS n, round(avg(gain), 6) AS mean, round(stddev_pop(gain) / sqrt(count(*)), 6) AS se, round(avg((gain > 0)::INT), 6) AS wins FROM gains",
    "xp7_bootstrap": f"WITH {_DELTA}, u AS (SELECT delta, r, {_DRAW.format('r', 'entity')} / 4294967296.0::DOUBLE AS u FROM dl, (SELECT unnest(range(100)) AS r)), w AS (SELECT delta, r, {_POISSON} AS w FROM u), ms AS (SELECT sum(w * delta) / sum(w) AS m FROM w GROUP BY r), q AS (SELECT quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM ms) SELECT (SELECT round(avg(delta), 6) FROM dl) AS mean, round(low, 6) AS low, round(high, 6) AS high, low > 0 OR high < 0 AS significant FROM q",
    "xp8_picked_on_half": f"WITH {_GRID}, h AS {_SPLITS.format('grid')}, a AS (SELECT split, beta, round(avg(gain) FILTER (train), 9) AS a, avg(gain) FILTER (NOT train) AS held_out FROM h GROUP BY ALL) SELECT split, beta, round(held_out, 6) AS held_out FROM a QUALIFY row_number() OVER (PARTITION BY split ORDER BY a DESC, beta) = 1",
    "xp9_held_out_curve": f"WITH {_DELTA}, h AS {_SPLITS.format('dl')} SELECT split, round(avg(delta), 6) AS mean, count(*) AS n FROM h WHERE NOT train GROUP BY split",
    "xp10_grid_curve": f"WITH {_GRID} SELECT beta, count(*) AS n, round(avg(gain), 6) AS mean, round(stddev_samp(gain) / sqrt(count(*)), 6) AS se FROM grid GROUP BY beta",
    "xp11_leave_one_out": f"WITH {_PAIRS}, r AS (SELECT *, g + q AS t FROM pairs), {_fit('r', 'q', 'n', 't')} SELECT entity, round(fitted, 6) AS fitted FROM fit",
    "xp11_fit_quality": f"WITH r AS (SELECT (s_suppkey % 17)::DOUBLE AS a, (s_suppkey % 5)::DOUBLE AS b, s_acctbal / 1000 AS t FROM supplier), {_fit('r', 'a', 'b', 't')}, e AS (SELECT t, (t - fitted) / (1 - lev) AS e FROM fit) SELECT round(1 - avg(e * e) / var_pop(t), 6) AS r2, round(sqrt(avg(e * e)), 6) AS rmse FROM e",
    "xp12_features": f"WITH {SIGNAL} SELECT entity, round(quantile_cont(value, 0.5), 6) AS median, round(stddev_pop(value), 6) AS sd, round((max(value) - min(value)) / 2, 6) AS half_spread, round(ln(1 + count(value)), 6) AS log_n FROM s GROUP BY entity",
    "xp17_transfer": f"WITH {_DELTA}, b AS (SELECT least(4, floor(q * 5))::INT AS bin, avg(delta) AS delta FROM dl GROUP BY 1), t AS (SELECT least(4, floor(y * 5))::INT AS bin, count(*) AS n FROM pairs GROUP BY 1) SELECT round(sum(coalesce(delta, 0) * n) / sum(n), 6) AS expected FROM t LEFT JOIN b USING (bin)",
    "xp18_agreement": f"WITH {_PAIRS} SELECT count(*) AS n, round(avg((abs(g - y) > 1e-9)::INT), 6) AS differ, round(avg((sign(g - 0.5) = sign(y - 0.5))::INT), 6) AS same_side, round(avg(g - y) FILTER (sign(g - 0.5) = sign(y - 0.5)), 6) AS difference FROM pairs",
    "xp20_paired_centers": f"WITH {DETS}, p AS (SELECT entity, frame, cls, greatest(0, least(1, sum(conf * area * c) / sum(conf * area))) AS center FROM dets GROUP BY ALL HAVING sum(conf * area) > 0) SELECT x.entity, count(*) AS n, round(quantile_cont(x.center, 0.5), 6) AS a, round(quantile_cont(z.center, 0.5), 6) AS b, round(corr(x.center, z.center), 6) AS r FROM p x JOIN p z ON x.entity = z.entity AND x.frame = z.frame AND x.cls = 'R' AND z.cls = 'A' GROUP BY x.entity",
    "xp21_profile": f"WITH {SIGNAL}, e AS (SELECT count(*) AS n FROM s GROUP BY entity), st AS (SELECT frame - lag(frame) OVER (PARTITION BY entity ORDER BY frame) AS step FROM s) SELECT count(*) AS entities, sum(n)::BIGINT AS rows, min(n) AS least, round(avg(n), 6) AS mean, max(n) AS most, (SELECT step FROM st WHERE step IS NOT NULL GROUP BY step ORDER BY count(*) DESC, step LIMIT 1) AS step FROM e",
}
