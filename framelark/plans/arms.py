"""Queries of loose replies, maps, ceilings and arms (whole predictions composed of the parts), with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry, text
from ..operators import pool
from ..sources import frames as src
from ._base import CROP, DETS, META, SIGNAL, rounded


def _reply(s, d):
    """Events as replies: an object of another key, the event's own (its key by one of two names), one that doesn't parse."""
    own = F.when(F.col("event_id") % 2 == 0, F.replace("props", F.lit('"k"'), F.lit('"key"'))).otherwise(F.col("props"))
    return src.table(s, d, "events").select("event_id", F.concat(F.lit('so {"j": 1}, '), own, F.lit(' and {"k": }')).alias("reply"))


def _crops(s, d):
    m = src.meta(s, d)
    cw, ch = geometry.crop_size(F.col("w"), F.col("h"), F.col("tw"), F.col("th"))
    return m.select("entity", "w", "h", "n_frames", cw.alias("cw"), ch.alias("ch"))


def centre_arm(s, d, step: int = 3):
    """Centre crop on every ``step``-th frame of each clip."""
    frames = F.explode(F.sequence(F.lit(0), F.col("n_frames") - 1, F.lit(step))).alias("frame")
    return _crops(s, d).select("entity", frames, geometry.center_to_box(F.lit(0.5), F.col("w"), F.col("cw")).alias("x"), geometry.center_to_box(F.lit(0.5), F.col("h"), F.col("ch")).alias("y"))


def gated_arm(s, d, clutter: float = 85.0, beta: float = 0.5):
    """One box a clip: the shrunk median centre of its detections, or the middle where there are none or too many a frame."""
    centers = pool.entity_centers(pool.pool_frames(src.detections(s, d)))
    gated = F.col("median").isNull() | (F.col("clutter") > clutter)
    c = F.when(gated, 0.5).otherwise(geometry.shrink(F.col("median"), beta))
    return _crops(s, d).join(centers, "entity", "left").select("entity", gated.alias("gated"), geometry.center_to_box(c, F.col("w"), F.col("cw")).alias("x"))


def ceilings(truth, width: float = 169.0):
    """Per entity the mean overlap of one constant box at the median of the truth: the most that a constant can reach, or nearly."""
    mid = truth.groupBy("entity").agg(F.median("x").alias("m"))
    shared = F.greatest(F.lit(0.0), width - F.abs(F.col("x") - F.col("m")))
    return truth.join(mid, "entity").groupBy("entity").agg(F.avg(shared / (2 * width - shared)).alias("ceiling"))


def sign_agreement(s, d):
    """How often two estimates lie on one side of the middle, and their mean difference where they do and don't."""
    median = pool.entity_centers(pool.pool_frames(src.detections(s, d))).select("entity", (F.col("median") - 0.5).alias("a"))
    mean = src.detections(s, d).groupBy("entity").agg((F.round(F.avg("c"), 9) - 0.5).alias("b"))
    agree = F.sign(F.round("a", 9)) == F.sign("b")
    both = median.join(mean, "entity").select(agree.alias("agree"), (F.col("a") - F.col("b")).alias("delta"))
    return both.groupBy("agree").agg(F.count(F.lit(1)).alias("n"), F.avg("delta").alias("mean_delta"))


QUERIES = {
    "sf4_last_object": lambda s, d: _reply(s, d).select("event_id", text.aliased(text.last_object(F.col("reply"), ["k", "key"]), ["k", "key"]).alias("k")),
    "sf7_alias": lambda s, d: _reply(s, d).select("event_id", text.aliased(text.last_object(F.col("reply"), ["j"]), ["k", "j"]).alias("k")),
    "sf10_base_name": lambda s, d: src.table(s, d, "orders").select("o_orderkey", text.base_name(F.concat(F.lit("/clips/a.b/"), F.col("o_orderkey").cast("string"), F.lit(".mp4"))).alias("name")),
    "sf11_format": lambda s, d: src.table(s, d, "orders").select("o_orderkey", F.format_string("%05d", "o_orderkey").alias("label")),
    "sc5_json_map": lambda s, d: src.table(s, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,double>")).alias("key", "number")),
    "sc12_strided": lambda s, d: rounded(src.signal(s, d).where("frame % 3 = 0").select("entity", "frame", "value")),
    "sk2_json_map": lambda s, d: src.boxes(s, d, "F").groupBy("entity").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("frame", F.col("x").cast("int")))))).alias("boxes")),
    "pr25_truth_map": lambda s, d: src.boxes(s, d, "O").groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.min_by("x", "frame").alias("first_x")),
    "xp14_ceilings": lambda s, d: rounded(ceilings(src.boxes(s, d, "O"))),
    "xp19_sign_agreement": lambda s, d: rounded(sign_agreement(s, d)),
    "ar1_centre_crop": centre_arm,
    "ar5_gated_overlay": gated_arm,
}

_TRUTH = "t AS (SELECT l_orderkey AS entity, l_linenumber AS frame, min(l_partkey % 200)::DOUBLE AS x FROM lineitem WHERE l_linestatus = '{}' GROUP BY ALL)"
_CENTER = f"{DETS}, pooled AS (SELECT entity, frame, greatest(0.0, least(1.0, sum(conf * area * c) / sum(conf * area))) AS center, count(*) AS n FROM dets GROUP BY ALL HAVING sum(conf * area) > 0), cs AS (SELECT entity, quantile_cont(center, 0.5) AS median, avg(n) AS clutter FROM pooled GROUP BY entity)"
ORACLE_SQL = {
    "sf4_last_object": "SELECT event_id, (props->>'$.k')::DOUBLE AS k FROM events",
    "sf7_alias": "SELECT event_id, 1.0::DOUBLE AS k FROM events",
    "sf10_base_name": "SELECT o_orderkey, o_orderkey::VARCHAR AS name FROM orders",
    "sf11_format": "SELECT o_orderkey, format('{:05d}', o_orderkey) AS label FROM orders",
    "sc5_json_map": "SELECT event_id, 'k' AS key, (props->>'$.k')::DOUBLE AS number FROM events WHERE props->>'$.k' IS NOT NULL",
    "sc12_strided": f"WITH {SIGNAL} SELECT entity, frame, round(value, 6) AS value FROM s WHERE frame % 3 = 0",
    "sk2_json_map": f"WITH {_TRUTH.format('F')} SELECT entity, '{{' || string_agg('\"' || frame || '\":' || x::INT, ',' ORDER BY frame) || '}}' AS boxes FROM t GROUP BY entity",
    "pr25_truth_map": f"WITH {_TRUTH.format('O')} SELECT entity, count(*) AS n, arg_min(x, frame) AS first_x FROM t GROUP BY entity",
    "xp14_ceilings": f"WITH {_TRUTH.format('O')}, i AS (SELECT entity, greatest(0.0::DOUBLE, 169 - abs(x - m)) AS i FROM t JOIN (SELECT entity, median(x) AS m FROM t GROUP BY entity) USING (entity)) SELECT entity, round(avg(i / (338 - i)), 6) AS ceiling FROM i GROUP BY entity",
    "xp19_sign_agreement": f"WITH {_CENTER}, b AS (SELECT entity, round(avg(c), 9) - 0.5 AS b FROM dets GROUP BY entity) SELECT sign(round(median - 0.5, 9)) = sign(b) AS agree, count(*) AS n, round(avg(median - 0.5 - b), 6) AS mean_delta FROM cs JOIN b USING (entity) GROUP BY 1",
    "ar1_centre_crop": f"WITH {META}, {CROP} SELECT entity, f::INT AS frame, round_even((w - cw) / 2, 0)::INT AS x, round_even((h - ch) / 2, 0)::INT AS y FROM crop, (SELECT unnest([0, 3, 6]) AS f)",
    "ar5_gated_overlay": f"""
        WITH {META}, {CROP}, {_CENTER}, g AS (SELECT entity, w, cw, median IS NULL OR clutter > 85 AS gated, median FROM crop LEFT JOIN cs USING (entity)),
        k AS (SELECT *, CASE WHEN gated THEN 0.5 ELSE 0.5 + 0.5 * (median - 0.5) END AS c FROM g)
        SELECT entity, gated, round_even(greatest(0, least(c * w - cw / 2, w - cw)), 0)::INT AS x FROM k
    """,
}
