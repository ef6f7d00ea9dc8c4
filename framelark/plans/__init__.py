"""Queries over the driver tables, by name, with the SQL each is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, text
from ..operators import intervals, pool, score, sequence, stats, validate
from ..sources import frames as src
from . import arms as _arms
from . import checks as _checks
from . import clips as _clips
from . import experiments as _experiments
from . import files as _files
from . import ordered as _ordered
from . import pools as _pools
from . import replies as _replies
from . import trials as _trials
from . import wholes as _wholes
from ._base import rounded


def _scores(spark, d):
    return score.score_entities(src.boxes(spark, d, "F"), src.boxes(spark, d, "O"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_scores(spark, d))


def _frames(spark, d):
    return src.detections(spark, d).select("entity", "frame").distinct()


def _run(spark, d, skip):
    li = src.table(spark, d, "lineitem").where(F.col("l_partkey") % 3 != skip)
    return li.groupBy(F.col("l_orderkey").alias("entity"), F.col("l_linenumber").alias("frame")).agg(F.min("l_partkey").alias("x"))


def crop_sizes(spark, d):
    o = src.table(spark, d, "orders").withColumn("W", (360 + F.col("o_orderkey") % 5 * 90).cast("double"))
    even = F.col("o_orderkey") % 2 == 0
    tw, th = F.when(even, 16.0).otherwise(9.0), F.when(even, 9.0).otherwise(16.0)
    cw, ch = geometry.crop_size(F.col("W"), F.lit(640.0), tw, th)
    o = o.select("o_orderkey", "W", cw.alias("cw"), ch.alias("ch"))
    return o.select("o_orderkey", "cw", "ch", geometry.free_axis(F.col("W"), F.lit(640.0), F.col("cw"), F.col("ch")).alias("axis"), geometry.center_to_box(geometry.shrink((F.col("o_orderkey") % 100) / 100.0, 0.5), F.col("W"), F.col("cw")).alias("x"))


def validated(spark, d):
    li = src.table(spark, d, "lineitem")
    rows = li.select(F.col("l_orderkey").alias("entity"), F.col("l_linenumber").cast("double").alias("frame"), (F.col("l_partkey") % 200 - 3).cast("double").alias("x"), F.lit(0.0).alias("y"), (F.col("l_quantity") * 4 - 8).alias("w"), F.lit(300.0).alias("h"), F.struct("l_extendedprice", "l_partkey", "l_suppkey", "l_shipdate").alias("pos"), F.lit(7).alias("n_frames"), F.lit(360.0).alias("width"), F.lit(300.0).alias("height"))
    return validate.check(rows).groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.count_if("soft").alias("n_soft"))


def signals(spark, d):
    s = src.signal(spark, d)
    return rounded(sequence.robust(s, "value").select("entity", "frame", sequence.zscore(F.col("value")).alias("z"), sequence.minmax(F.col("value")).alias("mm"), "robust", sequence.moving_average(F.col("value"), 2).alias("ma"), sequence.median3(F.col("value")).alias("med"), (F.col("value") - F.lag("value").over(sequence.by_frame())).alias("diff")))


def dense(spark, d):
    s = src.signal(spark, d)
    lengths = s.groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    return rounded(sequence.interpolate(s.where("frame % 7 = 3").withColumnRenamed("value", "y"), lengths))


QUERIES = {
    "ag1_score_entities": flagship,
    "ag2_macro_score": lambda s, d: rounded(score.macro(_scores(s, d))),
    "pr1_crop_sizes": crop_sizes,
    "fl1_validate": validated,
    "ag5_pool_frames": lambda s, d: rounded(pool.pool_frames(src.detections(s, d), 0.5)),
    "ag7_entity_centers": lambda s, d: rounded(pool.entity_centers(pool.pool_frames(src.detections(s, d)))),
    "ag10_pick_frames": lambda s, d: rounded(pool.pick_frames(src.detections(s, d), [(F.col("conf") * F.sqrt("area")).desc(), "c", "l_orderkey", "l_extendedprice"]).select("entity", "frame", "cls", "c", "l_orderkey")),
    "fl18_clutter_gate": lambda s, d: rounded(pool.gate(pool.entity_centers(pool.pool_frames(src.detections(s, d).where("cls = 'R'"))), src.table(s, d, "supplier").select(F.col("s_suppkey").alias("entity")), 20.0)),
    "jn13_overlay": lambda s, d: rounded(pool.overlay(src.table(s, d, "customer").select("c_custkey", "c_acctbal"), src.table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal")), "c_custkey", "c_acctbal")),
    "jn7_compare_runs": lambda s, d: rounded(score.compare_runs(_run(s, d, 0), _run(s, d, 1))),
    "wn_signals": signals,
    "wn4_ema": lambda s, d: rounded(sequence.ema(src.signal(s, d), "value")),
    "wn12_interpolate": dense,
    "iv1_islands": lambda s, d: intervals.islands(src.signal(s, d).where("value > 50").select("entity", "frame"), 0),
    "iv3_top_runs": lambda s, d: intervals.top_runs(intervals.islands(src.signal(s, d).where("value > 50").select("entity", "frame"), 1), 2),
    "iv5_merge_segments": lambda s, d: intervals.merge_segments(src.signal(s, d).select("entity", (F.col("frame") * 3).alias("start"), (F.col("frame") * 3 + F.floor(F.col("value") / 40)).alias("end"))),
    "iv10_best_window": lambda s, d: intervals.best_window(src.signal(s, d), "value", 0.3),
    "or4_top_fraction": lambda s, d: rounded(intervals.top_fraction(src.signal(s, d), "value", 0.25).select("entity", "frame", "value")),
    "xp1_auc": lambda s, d: rounded(stats.auc(src.signal(s, d), "value", F.col("event_type") == "purchase")),
    "xp3_shrinkage": lambda s, d: rounded(stats.shrinkage(src.detections(s, d), "c", "area")),
    "xp5_leave_one_out": lambda s, d: rounded(stats.leave_one_out(src.signal(s, d), "frame", "value").select("entity", "frame", "loo_slope")),
    "ag18_binned": lambda s, d: rounded(stats.binned(src.detections(s, d), "conf", [0.5, 0.6, 0.75, 0.9], "area")),
    "jn9_anti": lambda s, d: src.resume(src.table(s, d, "orders").select("o_orderkey"), src.table(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct(), "o_orderkey"),
    "sf_numbers": lambda s, d: src.table(s, d, "events").select("event_id", text.last_numbers(F.col("props"), 1)[0].alias("k"), text.summary(F.col("props"), 4).alias("head")),
}

_BOXES = "SELECT l_orderkey AS entity, l_linenumber AS frame, min(l_partkey % 200)::DOUBLE AS x FROM lineitem WHERE l_linestatus = '{}' GROUP BY ALL"
_SCORES = f"""
    p AS ({_BOXES.format("F")}), t AS ({_BOXES.format("O")}),
    m AS (SELECT entity, frame, greatest(0, least(p.x + 169, t.x + 169) - greatest(p.x, t.x)) * 300.0 AS i FROM p JOIN t USING (entity, frame)),
    u AS (SELECT entity, frame, CASE WHEN i > 0 THEN i / (2 * 169 * 300 - i) ELSE 0 END AS iou FROM m),
    scores AS (
        SELECT entity, coalesce(np, 0) AS n_pred, nt AS n_truth, coalesce(mm, 0) AS matched, coalesce(si, 0.0) AS sum_iou,
               2 * coalesce(si, 0.0) / (coalesce(np, 0) + nt) AS f1
        FROM (SELECT entity, count(*) AS nt FROM t GROUP BY entity)
        LEFT JOIN (SELECT entity, count(*) AS np FROM p GROUP BY entity) USING (entity)
        LEFT JOIN (SELECT entity, count(*) AS mm, sum(iou) AS si FROM u GROUP BY entity) USING (entity))
"""
_DETS = "dets AS (SELECT l_suppkey AS entity, l_linenumber AS frame, l_returnflag AS cls, 1 - l_discount * 5 AS conf, l_quantity / 50 AS area, (l_partkey % 1000) / 1000.0::DOUBLE AS c, l_orderkey, l_extendedprice FROM lineitem)"
_POOL = "SELECT entity, frame, greatest(0.0, least(1.0, sum(conf * area ** {p} * c) / sum(conf * area ** {p}))) AS center, count(*) AS n FROM dets {w} GROUP BY entity, frame HAVING sum(conf * area ** {p}) > 0"
_CENTERS = "SELECT entity, quantile_cont(center, 0.5) AS median, avg(n) AS clutter, avg((n = 1)::INT) AS single FROM pooled GROUP BY entity"
_SIGNAL = "s AS (SELECT user_id AS entity, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, value, event_type FROM events)"
_RUNS = "SELECT entity, min(frame) AS start, max(frame) AS \"end\", count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY entity ORDER BY frame) AS run FROM (SELECT entity, frame, coalesce((frame - lag(frame) OVER (PARTITION BY entity ORDER BY frame) > {g})::INT, 1) AS new FROM s WHERE value > 50)) GROUP BY entity, run"

ORACLE_SQL: dict[str, str] = {
    "ag1_score_entities": f"WITH {_SCORES} SELECT entity, n_pred, n_truth, matched, round(sum_iou, 6) AS sum_iou, round(f1, 6) AS f1 FROM scores",
    "ag2_macro_score": f"WITH {_SCORES} SELECT round(avg(f1), 6) AS f1_skip, round(avg(coalesce(f1, 0)), 6) AS f1_zero, round(avg(coalesce(f1, 1)), 6) AS f1_one, sum(n_pred)::BIGINT AS n_pred, sum(n_truth)::BIGINT AS n_truth, sum(matched)::BIGINT AS matched, round(sum(sum_iou) / sum(matched), 6) AS mean_iou FROM scores",
    "pr1_crop_sizes": """
        WITH o AS (SELECT o_orderkey, (360 + o_orderkey % 5 * 90)::DOUBLE AS W, CASE WHEN o_orderkey % 2 = 0 THEN 16.0::DOUBLE / 9 ELSE 9.0::DOUBLE / 16 END AS r FROM orders),
        c AS (SELECT *, CASE WHEN W / 640 >= r THEN least(round_even(640 * r, 0), W) ELSE W END AS cw, CASE WHEN W / 640 >= r THEN 640 ELSE least(round_even(W / r, 0), 640) END AS ch FROM o)
        SELECT o_orderkey, cw::INT AS cw, ch::INT AS ch, CASE WHEN cw < W THEN 'x' WHEN ch < 640 THEN 'y' ELSE 'none' END AS axis,
               round_even(greatest(0, least((0.5::DOUBLE * ((o_orderkey % 100) / 100.0::DOUBLE) + 0.25) * W - cw / 2, W - cw)), 0)::INT AS x FROM c
    """,
    "fl1_validate": """
        WITH r AS (SELECT l_orderkey AS entity, l_linenumber AS frame, (l_partkey % 200 - 3)::DOUBLE AS x, l_quantity * 4 - 8 AS w, l_extendedprice, l_partkey, l_suppkey, l_shipdate FROM lineitem),
        c AS (SELECT *, CASE WHEN frame >= 7 THEN 'frame' WHEN x < 0 OR w <= 0 THEN 'bbox' WHEN x + w > 361 THEN 'bounds' END AS code FROM r),
        t AS (SELECT *, row_number() OVER (PARTITION BY entity, frame, code IS NULL ORDER BY l_extendedprice, l_partkey, l_suppkey, l_shipdate) AS turn FROM c),
        d AS (SELECT CASE WHEN code IS NULL AND turn > 1 THEN 'dup' ELSE code END AS code, x + w > 360 AS over FROM t)
        SELECT code, count(*) AS n, count(*) FILTER (code IS NULL AND over) AS n_soft FROM d GROUP BY code
    """,
    "ag5_pool_frames": f"WITH {_DETS}, pooled AS ({_POOL.format(p='0.5::DOUBLE', w='')}) SELECT entity, frame, round(center, 6) AS center, n FROM pooled",
    "ag7_entity_centers": f"WITH {_DETS}, pooled AS ({_POOL.format(p=1, w='')}), c AS ({_CENTERS}) SELECT entity, round(median, 6) AS median, round(clutter, 6) AS clutter, round(single, 6) AS single FROM c",
    "ag10_pick_frames": f"WITH {_DETS} SELECT entity, frame, cls, round(c, 6) AS c, l_orderkey FROM dets QUALIFY row_number() OVER (PARTITION BY entity, frame ORDER BY conf * sqrt(area) DESC, c, l_orderkey, l_extendedprice) = 1",
    "fl18_clutter_gate": f"WITH {_DETS}, pooled AS ({_POOL.format(p=1, w=chr(87) + 'HERE cls = ' + chr(39) + 'R' + chr(39))}), c AS ({_CENTERS}) SELECT s_suppkey AS entity, round(CASE WHEN median IS NULL OR clutter > 20 THEN 0.5 ELSE median END, 6) AS center, median IS NULL OR clutter > 20 AS fallback FROM supplier LEFT JOIN c ON s_suppkey = entity",
    "jn13_overlay": "SELECT c_custkey, round(coalesce(m, c_acctbal), 6) AS c_acctbal, m IS NOT NULL AS patched FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS m FROM orders GROUP BY 1) ON c_custkey = o_custkey",
    "jn7_compare_runs": """
        WITH a AS (SELECT l_orderkey AS entity, l_linenumber AS frame, min(l_partkey) AS ax FROM lineitem WHERE l_partkey % 3 <> 0 GROUP BY ALL),
        b AS (SELECT l_orderkey AS entity, l_linenumber AS frame, min(l_partkey) AS bx FROM lineitem WHERE l_partkey % 3 <> 1 GROUP BY ALL)
        SELECT entity, count(ax) AS n_a, count(bx) AS n_b, count(ax + bx) AS shared, round(count(ax + bx) / count(*), 6) AS jaccard, round(avg(abs(ax - bx)), 6) AS mean_offset FROM a FULL JOIN b USING (entity, frame) GROUP BY entity
    """,
    "wn_signals": f"""
        WITH {_SIGNAL}, q AS (SELECT entity, quantile_cont(value, 0.1) AS lo, quantile_cont(value, 0.9) AS hi FROM s GROUP BY 1),
        w AS (SELECT s.*, lo, hi, avg(value) OVER e AS m, stddev_pop(value) OVER e AS sd, min(value) OVER e AS mn, max(value) OVER e AS mx, first(value) OVER f AS v0, last(value) OVER f AS v1, max(frame) OVER e AS fmax,
              sum(value) OVER (PARTITION BY entity ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s5, lag(value) OVER o AS a, lead(value) OVER o AS b
              FROM s JOIN q USING (entity) WINDOW e AS (PARTITION BY entity), o AS (PARTITION BY entity ORDER BY frame), f AS (PARTITION BY entity ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
        SELECT entity, frame, round(CASE WHEN sd > 1e-9 THEN (value - m) / sd ELSE 0 END, 6) AS z, round(CASE WHEN mx > mn THEN (value - mn) / (mx - mn) ELSE 0 END, 6) AS mm,
               round(CASE WHEN hi > lo THEN greatest(0, least(1, (value - lo) / (hi - lo))) ELSE 0 END, 6) AS robust,
               round((s5 + greatest(0, 2 - frame) * v0 + greatest(0, 2 - (fmax - frame)) * v1) / 5, 6) AS ma, round(list_sort([coalesce(a, value), value, coalesce(b, value)])[2], 6) AS med, round(value - a, 6) AS diff FROM w
    """,
    "wn12_interpolate": f"""
        WITH {_SIGNAL}, y AS (SELECT entity, frame, CASE WHEN frame % 7 = 3 THEN value END AS y, CASE WHEN frame % 7 = 3 THEN frame END AS pos FROM s),
        d AS (SELECT entity, frame, last_value(pos IGNORE NULLS) OVER b AS pf, last_value(y IGNORE NULLS) OVER b AS p, first_value(pos IGNORE NULLS) OVER a AS nf, first_value(y IGNORE NULLS) OVER a AS n FROM y
              WINDOW b AS (PARTITION BY entity ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY entity ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
        SELECT entity, frame, round(CASE WHEN p IS NULL THEN n WHEN n IS NULL OR nf = pf THEN p ELSE p + (n - p) * (frame - pf) / (nf - pf) END, 6) AS linear, round(coalesce(p, n), 6) AS asof,
               round(CASE WHEN p IS NULL OR nf - frame < frame - pf THEN n ELSE p END, 6) AS nearest FROM d
    """,
    "wn4_ema": f"WITH RECURSIVE {_SIGNAL}, e AS (SELECT entity, frame, value AS ema FROM s WHERE frame = 0 UNION ALL SELECT s.entity, s.frame, 0.3::DOUBLE * s.value + 0.7::DOUBLE * e.ema FROM e JOIN s ON s.entity = e.entity AND s.frame = e.frame + 1) SELECT entity, frame, round(ema, 6) AS ema FROM e",
    "iv1_islands": f"WITH {_SIGNAL} {_RUNS.format(g=1)}",
    "iv3_top_runs": f"WITH {_SIGNAL}, runs AS ({_RUNS.format(g=2)}) SELECT *, row_number() OVER (PARTITION BY entity ORDER BY n DESC, start DESC) AS place FROM runs QUALIFY place <= 2",
    "iv5_merge_segments": f"""
        WITH {_SIGNAL}, g AS (SELECT entity, 3 * frame AS start, 3 * frame + floor(value / 40)::BIGINT AS "end" FROM s),
        n AS (SELECT *, coalesce((start > max("end") OVER (PARTITION BY entity ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1)::INT, 1) AS new FROM g),
        i AS (SELECT *, sum(new) OVER (PARTITION BY entity ORDER BY start, "end") AS id FROM n)
        SELECT entity, min(start) AS start, max("end") AS "end" FROM i GROUP BY entity, id
    """,
    "iv10_best_window": f"""
        WITH {_SIGNAL}, n AS (SELECT *, greatest(1, round_even(0.3 * count(*) OVER (PARTITION BY entity), 0))::INT AS len FROM s),
        w AS (SELECT a.entity, a.frame, a.len, round(sum(b.value), 6) AS total, count(*) AS k FROM n a JOIN n b ON a.entity = b.entity AND b.frame BETWEEN a.frame AND a.frame + a.len - 1 GROUP BY ALL)
        SELECT entity, frame AS start, len AS length, total FROM w WHERE k = len QUALIFY row_number() OVER (PARTITION BY entity ORDER BY total DESC, frame) = 1
    """,
    "or4_top_fraction": f"WITH {_SIGNAL} SELECT entity, frame, round(value, 6) AS value FROM s QUALIFY row_number() OVER (PARTITION BY entity ORDER BY value DESC, frame) <= greatest(1, round_even(0.25 * count(*) OVER (PARTITION BY entity), 0))",
    "xp1_auc": f"""
        WITH {_SIGNAL}, p AS (SELECT a.entity, avg(CASE WHEN a.value > b.value THEN 1.0 WHEN a.value = b.value THEN 0.5 ELSE 0 END) AS auc FROM s a JOIN s b ON a.entity = b.entity AND a.event_type = 'purchase' AND b.event_type <> 'purchase' GROUP BY 1)
        SELECT entity, count(*) FILTER (event_type = 'purchase') AS n_pos, count(*) FILTER (event_type <> 'purchase') AS n_neg, round(any_value(auc), 6) AS auc FROM s LEFT JOIN p USING (entity) GROUP BY entity
    """,
    "xp3_shrinkage": f"WITH {_DETS} SELECT entity, count(*) AS n, round(corr(c, area), 6) AS r, round(regr_slope(c, area), 6) AS beta, round(var_samp(area), 6) AS var_estimate, round(covar_samp(c, area), 6) AS cov FROM dets GROUP BY entity",
    "xp5_leave_one_out": f"WITH {_SIGNAL} SELECT a.entity, a.frame, round(regr_slope(b.value, b.frame), 6) AS loo_slope FROM s a LEFT JOIN s b ON a.entity = b.entity AND a.frame <> b.frame GROUP BY 1, 2",
    "ag18_binned": f"WITH {_DETS} SELECT (conf >= 0.5)::INT + (conf >= 0.6)::INT + (conf >= 0.75)::INT + (conf >= 0.9)::INT AS bin, count(*) AS n, round(avg(area), 6) AS mean FROM dets GROUP BY 1",
    "jn9_anti": "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
    "sf_numbers": "SELECT event_id, regexp_extract_all(props, '-?\\d+(?:\\.\\d+)?')[-1]::DOUBLE AS k, left(regexp_replace(props, '\\s+', '', 'g'), 4) AS head FROM events",
}

for _part in (_clips, _checks, _pools, _ordered, _trials, _arms, _replies, _experiments, _files, _wholes):
    QUERIES.update(_part.QUERIES)
    ORACLE_SQL.update(_part.ORACLE_SQL)
