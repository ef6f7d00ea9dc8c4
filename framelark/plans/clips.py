"""Queries over crop geometry, with SQL. Orders play clips, their lines boxes and detections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..sources import frames as src
from ._base import CROP, META, rounded, rounded_even

_LINES = "SELECT entity, w, h, cw, ch, tw, th, l_linenumber AS line, (l_partkey % 1000) / 1000.0::DOUBLE AS c, (l_suppkey % 100) / 100.0::DOUBLE AS cy, l_quantity / 50 AS area, l_partkey AS part, l_suppkey AS supp, l_quantity AS q, l_discount AS disc FROM crop JOIN lineitem ON l_orderkey = entity"


def crops(spark, d):
    """Clips with the size of their crop."""
    m = src.meta(spark, d)
    cw, ch = g.crop_size(*(F.col(c) for c in ("w", "h", "tw", "th")))
    return m.withColumn("cw", cw).withColumn("ch", ch)


def lines(spark, d):
    """Lines with their clip: every line is one detection or box."""
    li = src.table(spark, d, "lineitem")
    return crops(spark, d).join(li, F.col("entity") == F.col("l_orderkey")).select("entity", "w", "h", "cw", "ch", "tw", "th", F.col("l_linenumber").alias("line"), ((F.col("l_partkey") % 1000) / 1000.0).alias("c"), ((F.col("l_suppkey") % 100) / 100.0).alias("cy"), (F.col("l_quantity") / 50).alias("area"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_quantity").alias("q"), F.col("l_discount").alias("disc"))


def _of_lines(columns):
    return lambda s, d: rounded(lines(s, d).select("entity", "line", "part", "supp", "q", *columns()))


_C = F.col
_KEYS = "entity, line, part, supp, q"


def _struct(name, *fields):
    return lambda df: df.select(*(c for c in df.columns if c != name), *(F.col(f"{name}.{f}").alias(f) for f in fields))


def _clips(make, *fields):
    """A query of one struct for each clip."""
    return lambda s, d: rounded(_struct("r", *fields)(src.meta(s, d).select("entity", make().alias("r"))))


def _start():
    return (_C("entity") % 7).cast("double")


def _end():
    return (_C("entity") % 11 + 1).cast("double")


_SQL_START, _SQL_END = "(entity % 7)::DOUBLE", "(entity % 11 + 1)::DOUBLE"

QUERIES = {
    "pr2b_ratio_axis": lambda s, d: src.meta(s, d).select("entity", g.ratio_axis(_C("tw"), _C("th")).alias("axis")),
    "pr3_box_from_triplet": lambda s, d: rounded(_struct("b", "x0", "y0", "x1", "y1")(lines(s, d).select("entity", "line", "part", "supp", "q", g.corners(_C("part") % 200, F.lit(0), _C("q"), _C("tw"), _C("th")).alias("b")))),
    "pr6_offset_from_center": _of_lines(lambda: [g.offset(_C("c"), _C("w"), _C("cw"), 1 - _C("disc") * 5).alias("offset")]),
    "pr7_boxes_from_offsets": lambda s, d: crops(s, d).withColumn("frame", F.explode(F.sequence(F.lit(0), F.col("n_frames") - 1))).select("entity", "frame", g.center_to_box(g.shrink((_C("entity") + _C("frame") * 7) % 100 / 100.0, 0.5), _C("w"), _C("cw")).alias("x")),
    "pr8_centred_boxes": lambda s, d: crops(s, d).select("entity", *(c.alias(n) for n, c in g.centred(_C("w"), _C("cw")).items())),
    "pr9_truth_center": _of_lines(lambda: [g.truth_center(_C("part") % 200, F.lit(0), _C("q"), _C("w"), _C("h"), _C("tw"), _C("th"), g.ratio_axis(_C("tw"), _C("th"))).alias("center")]),
    "pr11_soft_shrink": _of_lines(lambda: [g.soft_shrink(_C("c"), _C("line"), 2.5).alias("center")]),
    "pr13_pseudo_box": lambda s, d: rounded(_struct("b", "x0", "y0", "x1", "y1")(lines(s, d).select("entity", "line", "part", "supp", "q", g.pseudo_box(_C("c"), _C("cy"), _C("area"), _C("w"), _C("h")).alias("b")))),
    "pr14_normalise": lambda s, d: _struct("b", "cx", "cy", "area")(lines(s, d).select("entity", "line", "part", "supp", "q", g.normalised(_C("part") % 200, _C("supp") % 50, _C("part") % 200 + _C("q"), _C("supp") % 50 + _C("q") * 2, _C("w"), _C("h")).alias("b"))),
    "pr15_seconds_to_frames": lambda s, d: src.meta(s, d).select("entity", g.frames_of_segment(_start(), _end(), F.lit(2.5), F.lit(25)).alias("a"), g.frames_of_share(F.least(_start(), _end() - 1), _end(), F.lit(12.0), F.lit(25)).alias("b")).select("entity", F.col("a.start").alias("start"), F.col("a.end").alias("end"), F.col("b.start").alias("first"), F.col("b.end").alias("stop")),
    "pr16_widen": _clips(lambda: g.widen(_start(), _start() + _end(), 1.5, F.lit(0.0), F.lit(15.0)), "start", "end"),
    "pr17_keep_ratio": _clips(lambda: g.keep_ratio(_start().cast("int"), (_start() + _end()).cast("int"), F.lit(20), 0.3, 0.5), "start", "end"),
    "pr18_lerp": lambda s, d: lines(s, d).select("entity", "line", "part", "supp", "q", g.lerp(F.array(*(_C(c).cast("double") for c in ("line", "part", "supp", "q"))), F.array(F.lit(9.0), F.lit(99.0), F.lit(5.0), _C("q") * 3), _C("disc") * 5).alias("m")).select("entity", "line", "part", "supp", "q", *(F.col("m")[i].alias(f"m{i}") for i in range(4))),
    "pr19_even_indices": lambda s, d: src.meta(s, d).select("entity", F.explode(g.even_indices((_C("entity") % 40).cast("int"), 6)).alias("place")),
    "pr20_kept_frames": lambda s, d: src.meta(s, d).select("entity", g.kept_frames((_C("entity") % 40).cast("int"), 0.08).alias("n")),
    "pr21_ceilings": lambda s, d: rounded_even(lines(s, d).select("entity", "line", "part", "supp", "q", *(c.alias(n) for n, c in g.ceilings(_C("c"), _C("q")).items()))),
    "pr22_coordinate_scale": _of_lines(lambda: [g.unit_coordinate(_C("part") * 0.75, _C("w")).alias("unit"), g.scale_of(F.array(-_C("q") * 4, _C("area"))).alias("scale")]),
    "pr23_crop_width": lambda s, d: rounded(crops(s, d).select("entity", (_C("cw") / _C("w")).alias("share"))),
    "pr24_safe_ratio": _clips(lambda: g.safe_ratio(F.split(F.concat((_C("entity") % 5 - 1).cast("string"), F.lit(":"), F.when(_C("entity") % 3 == 0, "x").otherwise((_C("entity") % 4).cast("string"))), ":")), "tw", "th"),
    "fl16_full_frame": lambda s, d: crops(s, d).where((_C("cw") == _C("w")) & (_C("ch") == _C("h"))).select("entity"),
    "fl17_portrait": lambda s, d: crops(s, d).where(g.free_axis(_C("w"), _C("h"), _C("cw"), _C("ch")) == "y").select("entity"),
}

_ON = f"WITH {META}, {CROP}, lines AS ({_LINES})"
ORACLE_SQL = {
    "pr2b_ratio_axis": f"WITH {META} SELECT entity, CASE WHEN th > tw THEN 'x' ELSE 'y' END AS axis FROM meta",
    "pr3_box_from_triplet": f"{_ON} SELECT {_KEYS}, part % 200 AS x0, 0 AS y0, round(part % 200 + q, 6) AS x1, round(q * th / tw, 6) AS y1 FROM lines",
    "pr6_offset_from_center": f"{_ON} SELECT {_KEYS}, round(greatest(0, least(((1 - disc * 5) * c + (1 - (1 - disc * 5)) * 0.5) * w - cw / 2, w - cw)), 6) AS \"offset\" FROM lines",
    "pr7_boxes_from_offsets": f"WITH {META}, {CROP} SELECT entity, f.frame::INT AS frame, round_even(greatest(0, least((0.5::DOUBLE * ((entity + f.frame * 7) % 100 / 100.0::DOUBLE) + 0.25) * w - cw / 2, w - cw)), 0)::INT AS x FROM crop, range(8) f(frame)",
    "pr8_centred_boxes": f"WITH {META}, {CROP} SELECT entity, round_even((w - cw) / 2, 0)::INT AS half_even, floor((w - cw) / 2)::INT AS \"floor\", round_even(greatest(0, least(0.5 * w - cw / 2, w - cw)), 0)::INT AS \"offset\" FROM crop",
    "pr9_truth_center": f"{_ON} SELECT {_KEYS}, round(CASE WHEN th > tw THEN (part % 200 + q / 2) / w ELSE (q * th / tw / 2) / h END, 6) AS center FROM lines",
    "pr11_soft_shrink": f"{_ON} SELECT {_KEYS}, round(0.5 + (c - 0.5) * exp(-line / 2.5), 6) AS center FROM lines",
    "pr13_pseudo_box": f"{_ON}, p AS (SELECT *, sqrt(area) / 2 AS r FROM lines) SELECT {_KEYS}, round(greatest(c - r, 0) * w, 6) AS x0, round(greatest(cy - r, 0) * h, 6) AS y0, round(least(c + r, 1) * w, 6) AS x1, round(least(cy + r, 1) * h, 6) AS y1 FROM p",
    "pr14_normalise": f"{_ON} SELECT {_KEYS}, round_even((part % 200 + (part % 200 + q)) / 2 / w * 1e5, 0) / 1e5 AS cx, round_even((supp % 50 + (supp % 50 + q * 2)) / 2 / h * 1e5, 0) / 1e5 AS cy, round_even(((part % 200 + q) - part % 200) * ((supp % 50 + q * 2) - supp % 50) / (w * h) * 1e6, 0) / 1e6 AS area FROM lines",
    "pr15_seconds_to_frames": f"""
        WITH {META}, t AS (SELECT entity, {_SQL_START} AS s, {_SQL_END} AS e FROM meta),
        a AS (SELECT *, greatest(0, least(round_even(least(s, e) * 2.5::DOUBLE, 0)::INT, 24)) AS x, greatest(0, least(round_even(greatest(s, e) * 2.5::DOUBLE, 0)::INT, 24)) AS y,
              greatest(0, least(24, floor(least(s, e - 1) / 12.0::DOUBLE * 25)::INT)) AS first FROM t)
        SELECT entity, CASE WHEN y > x THEN x END AS start, CASE WHEN y > x THEN y END AS "end", first, greatest(first + 1, least(25, ceil(e / 12.0::DOUBLE * 25)::INT)) AS stop FROM a
    """,
    "pr16_widen": f"WITH {META}, t AS (SELECT entity, {_SQL_START} AS a, {_SQL_START} + {_SQL_END} AS b FROM meta) SELECT entity, round(greatest(0, (a + b) / 2 - (b - a) / 2 * 1.5), 6) AS start, round(least(15, (a + b) / 2 + (b - a) / 2 * 1.5), 6) AS \"end\" FROM t",
    "pr17_keep_ratio": f"""
        WITH {META}, t AS (SELECT entity, (entity % 7)::INT AS a, (entity % 7 + entity % 11 + 1)::INT AS b FROM meta),
        u AS (SELECT entity, CASE WHEN b - a < 6 THEN greatest(0, a - (6 - (b - a)) // 2) WHEN b - a > 10 THEN a + (b - a - 10) // 2 ELSE a END AS a,
              CASE WHEN b - a < 6 THEN least(20, b + (6 - (b - a)) - (6 - (b - a)) // 2) WHEN b - a > 10 THEN b - ((b - a - 10) - (b - a - 10) // 2) ELSE b END AS b FROM t)
        SELECT entity, greatest(0, least(19, a))::INT AS start, greatest(a + 1, least(20, b))::INT AS "end" FROM u
    """,
    "pr18_lerp": f"{_ON} SELECT {_KEYS}, " + ", ".join(f"round_even({a}::DOUBLE + ({b} - {a}::DOUBLE) * (disc * 5), 0)::INT AS m{i}" for i, (a, b) in enumerate((("line", "9.0::DOUBLE"), ("part", "99.0::DOUBLE"), ("supp", "5.0::DOUBLE"), ("q", "q * 3")))) + " FROM lines",
    "pr19_even_indices": f"WITH {META} SELECT DISTINCT entity, round_even(i * (entity % 40 - 1) / 5, 0)::INT AS place FROM meta, range(6) r(i) WHERE entity % 40 > 0",
    "pr20_kept_frames": f"WITH {META} SELECT entity, greatest(1, entity % 40 - round_even((entity % 40) * 0.08::DOUBLE, 0))::INT AS n FROM meta",
    "pr21_ceilings": f"{_ON} SELECT {_KEYS}, round_even(2 * c / (1 + q) * 1e6, 0) / 1e6 AS all_found, round_even(2 * c * q / (1 + q) * 1e6, 0) / 1e6 AS all_right FROM lines",
    "pr22_coordinate_scale": f"{_ON}, v AS (SELECT *, part * 0.75::DOUBLE AS v, greatest(q * 4, area) AS top FROM lines) SELECT {_KEYS}, round(least(1, greatest(0, CASE WHEN v <= 1.5 THEN v WHEN v <= 1000 THEN v / 1000 ELSE v / w END)), 6) AS unit, CASE WHEN top <= 1.5 THEN 1.0::DOUBLE WHEN top <= 150 THEN 100.0::DOUBLE ELSE 1000.0::DOUBLE END AS scale FROM v",
    "pr23_crop_width": f"WITH {META}, {CROP} SELECT entity, round(cw / w, 6) AS share FROM crop",
    "pr24_safe_ratio": f"WITH {META}, t AS (SELECT entity, entity % 5 - 1 AS a, CASE WHEN entity % 3 <> 0 THEN entity % 4 END AS b FROM meta) SELECT entity, CASE WHEN a > 0 AND b > 0 THEN a::DOUBLE ELSE 16.0::DOUBLE END AS tw, CASE WHEN a > 0 AND b > 0 THEN b::DOUBLE ELSE 9.0::DOUBLE END AS th FROM t",
    "fl16_full_frame": f"WITH {META}, {CROP} SELECT entity FROM crop WHERE cw = w AND ch = h",
    "fl17_portrait": f"WITH {META}, {CROP} SELECT entity FROM crop WHERE cw = w AND ch < h",
}
