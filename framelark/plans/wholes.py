"""Queries of whole arms, with SQL. Users play clips, their events samples of signals, brightness and detections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import arms, experiments, pool
from ..sources import folders, submissions
from ..sources import frames as src
from ._base import SIGNAL, rounded
from .experiments import _CLIPS, _TRUTH, _X, _f1
from .experiments import _clips as _suppliers
from .experiments import _truth as _supplier_truth

_C = F.col
_DET = "array<struct<cls: string, conf: double, cx: double, cy: double, area: double, top: double, bh: double>>"
CUTS, SOFTNESS = [50.0, 85.0, 100.0], [20.0, 80.0]


def _events(s, d):
    return src.signal(s, d).withColumn("v", _C("value"))


def _clips(s, d):
    """A third each: no free axis, wide pictures with portrait crops, portrait pictures with wide crops."""
    k = _C("entity") % 3
    c = src.signal(s, d).groupBy("entity").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return arms.sized(c.select("entity", "n", F.when(k == 1, 640).otherwise(360).alias("width"), F.when(k == 1, 360).otherwise(640).alias("height"), F.when(k == 2, 16.0).otherwise(9.0).alias("tw"), F.when(k == 2, 9.0).otherwise(16.0).alias("th")))


def _signals(s, d):
    return _events(s, d).select("entity", "frame", _C("v").alias("motion"), F.when(_C("entity") % 7 != 0, (_C("frame") * 7 % 11).cast("double")).alias("audio"))


def _flat_dets(s, d):
    e = _events(s, d)
    a = e.where("event_type = 'purchase'").select("entity", "frame", (_C("v") / 100).alias("cx"), (_C("frame") % 10 / 10).alias("cy"), (1 - _C("frame") % 7 / 10).alias("conf"), F.lit(0.2).alias("area"), F.lit(0).alias("pos"))
    b = e.where("v > 60").select("entity", "frame", (1 - _C("v") / 100).alias("cx"), F.lit(0.3).alias("cy"), F.lit(0.5).alias("conf"), F.lit(0.3).alias("area"), F.lit(1).alias("pos"))
    return a.unionByName(b)


def subject(s, d):
    return arms.subject_arm(_signals(s, d), _flat_dets(s, d), _clips(s, d), {"motion": 1.0, "audio": 0.5})


def _det(cls, conf, cx, cy, area, top=None, bh=None):
    return F.struct(cls.alias("cls"), conf.cast("double").alias("conf"), cx.cast("double").alias("cx"), cy.cast("double").alias("cy"), F.lit(area).alias("area"), (F.lit(None) if top is None else top).cast("double").alias("top"), (F.lit(None) if bh is None else bh).cast("double").alias("bh"))


def _sampled(s, d):
    kind = F.when(_C("entity") % 5 == 0, "car").when(_C("frame") % 6 == 0, "person").when(_C("entity") % 4 == 0, "dog").otherwise("car")
    one = _det(kind, 0.2 + _C("v") / 125, _C("v") / 100, (100 - _C("v")) / 100, 0.2)
    two = _det(F.when(_C("entity") % 5 == 0, "car").otherwise("person"), F.lit(0.6), _C("frame") % 10 / 10, F.lit(0.4), 0.1)
    return _events(s, d).where("frame % 3 = 0").select("entity", "frame", F.when(_C("v") > 70, F.array(one, two)).otherwise(F.array(one)).alias("dets"))


def _animal(s, d):
    return src.signal(s, d).where("entity % 8 = 0").select("entity").distinct()


def _pets(s, d):
    dog = F.array(_det(F.lit("dog"), F.lit(0.5), _C("frame") % 7 / 7, F.lit(0.2), 0.1))
    return _events(s, d).where("frame % 4 = 0 AND entity % 8 = 0").select("entity", "frame", F.when(_C("v") > 30, dog).otherwise(F.array().cast(_DET)).alias("dets"))


def _heads(s, d):
    p = _det(F.lit("person"), F.lit(0.9), F.lit(0.5), F.lit(0.9), 0.3, _C("frame") % 5 / 10, F.lit(0.4))
    return _events(s, d).where("frame % 3 = 0 AND entity % 2 = 1").select("entity", "frame", F.array(p).alias("dets"))


def _black(s, d):
    return _events(s, d).where("frame % 2 = 0").select("entity", "frame", _C("v").alias("mean"), (1 - _C("v") / 100).alias("dark"))


def _base(s, d):
    """Centred boxes on all frames but the last 8 %."""
    c = _clips(s, d)
    rows = c.select("entity", "width", "height", "cw", "ch", "axis", F.explode(F.sequence(F.lit(0), _C("n") - F.rint(0.08 * _C("n")).cast("int") - 1)).alias("frame"))
    x, y, w = arms.placed(arms.start(F.lit(0.5)))
    return rows.select("entity", "frame", x, y, w)


def trace(s, d):
    return arms.trace_arm(_base(s, d), _clips(s, d), _sampled(s, d), _animal(s, d), _pets(s, d), _heads(s, d), _black(s, d), threshold=0.9, least_single=0.3, width=3, dark=(0.5, 60.0), gap=1)


def heads(s, d):
    """Detections with and without the fields of whole persons, moved to the head."""
    e = _events(s, d)
    p = _det(F.when(_C("event_type") == "purchase", "person").otherwise("dog"), F.lit(0.9), F.lit(0.5), _C("v") / 100, 0.3, F.when(_C("frame") % 3 != 0, _C("frame") % 5 / 4), F.when(_C("frame") % 4 != 0, F.lit(0.4)))
    return rounded(e.select("entity", "frame", F.posexplode(arms.with_head_centers(F.array(p, p), 0.24)).alias("pos", "d")).select("entity", "frame", "pos", "d.cls", "d.cy", "d.cx"))


def reassembled(s, d):
    """Runs of boxes as files; users with even numbers have new frames."""
    names = lambda df: df.withColumn("video_id", _C("entity").cast("string"))
    clips = names(_clips(s, d)).select("video_id", "tw", "th")
    first, second = folders.shared_folder(s, "spatial"), folders.shared_folder(s, "temporal")
    submissions.write(submissions.nest(names(_base(s, d)), clips, 5.0), first)
    submissions.write(submissions.nest(names(_base(s, d)).where("entity % 2 = 0 AND frame % 5 = 0"), clips.where("video_id % 2 = 0")), second)
    kind = submissions.RECORD
    out = arms.reassembled(s.read.schema(kind).json(first), s.read.schema(kind).json(second))
    return out.select("video_id", "model_size_mb", "swapped", F.size("predictions").cast("long").alias("n"), F.aggregate("predictions", F.lit(0), lambda a, p: a + p["frame"] + F.get(p["bboxes"], F.lit(2))).cast("long").alias("total"))


def _const_f1(rows, clips, truth):
    """Mean F1 of one box a clip."""
    sized = rows.join(clips, "entity").select("by", "entity", "width", "crop", "h", "c", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("frame"))
    pred = sized.select("by", "entity", "frame", *experiments.box_row(_C("c")))
    real = truth.join(rows.select("entity", "by"), "entity").select("by", "entity", "frame", *experiments.BOX)
    return experiments.mean_f1(pred, real, "by")


def gates(s, d):
    frames = pool.pool_frames(src.detections(s, d))
    return rounded(arms.clutter_study(frames, _suppliers(s, d), _supplier_truth(s, d), CUTS, SOFTNESS, _const_f1))


QUERIES = {
    "ar2_subject_arm": subject,
    "ar6_trace_arm": trace,
    "ar8_gate_study": gates,
    "ar12_reassembled": reassembled,
    "pr12_head_centers": heads,
}

_SIZES = "cl AS (SELECT entity, count(*)::INT AS n, CASE WHEN entity % 3 = 1 THEN 640 ELSE 360 END AS w, CASE WHEN entity % 3 = 1 THEN 360 ELSE 640 END AS h, CASE WHEN entity % 3 = 1 THEN 202 ELSE 360 END AS cw, CASE entity % 3 WHEN 1 THEN 'x' WHEN 2 THEN 'y' ELSE 'none' END AS axis FROM s GROUP BY entity)"
#: Every crop moves over a side of 640 with an extent of 202.
_START = "CASE WHEN axis = 'none' THEN 0 ELSE greatest(0.0::DOUBLE, least({c} * 640 - 101, 438)) END"
_AT = "CASE WHEN axis = '{a}' THEN round_even({o}, 0) ELSE 0 END::INT"
_FILLED = "CASE WHEN {a} IS NULL THEN {b} WHEN {b} IS NULL OR {fa} = {fb} THEN {a} ELSE {a} + ({b} - {a}) * ({f} - {fa}) / ({fb} - {fa}) END"


def _between(rows: str, what: str, name: str, out: str) -> str:
    """``rows`` (entity, <what>, <name>) with the values of ``name`` before and after each row."""
    w = f"PARTITION BY entity ORDER BY {what} ROWS BETWEEN"
    known = f"CASE WHEN {name} IS NOT NULL THEN {what} END"
    return f"{out} AS (SELECT *, last_value({name} IGNORE NULLS) OVER ({w} UNBOUNDED PRECEDING AND CURRENT ROW) AS a, last_value({known} IGNORE NULLS) OVER ({w} UNBOUNDED PRECEDING AND CURRENT ROW) AS fa, first_value({name} IGNORE NULLS) OVER ({w} CURRENT ROW AND UNBOUNDED FOLLOWING) AS b, first_value({known} IGNORE NULLS) OVER ({w} CURRENT ROW AND UNBOUNDED FOLLOWING) AS fb FROM {rows})"


ORACLE_SQL = {
    "ar2_subject_arm": f"""
        WITH {SIGNAL}, {_SIZES}, g AS (SELECT entity, frame, value, event_type, CASE WHEN entity % 7 <> 0 THEN (frame * 7 % 11)::DOUBLE END AS audio FROM s),
        q AS (SELECT entity, quantile_cont(value, 0.1) AS m0, quantile_cont(value, 0.9) AS m1, quantile_cont(audio, 0.1) AS a0, quantile_cont(audio, 0.9) AS a1 FROM g GROUP BY entity),
        r AS (SELECT entity, frame, CASE WHEN m1 > m0 THEN greatest(0, least(1, (value - m0) / (m1 - m0))) ELSE 0 END AS m, CASE WHEN audio IS NULL THEN NULL WHEN a1 > a0 THEN greatest(0, least(1, (audio - a0) / (a1 - a0))) ELSE 0 END AS a FROM g JOIN q USING (entity)),
        sc AS (SELECT entity, frame, CASE WHEN a IS NULL THEN m ELSE (m + 0.5 * a) / 1.5 END AS score, n FROM r JOIN cl USING (entity)),
        sm AS (SELECT a.entity, a.frame, a.n, round(avg(b.score), 9) AS score FROM sc a JOIN (SELECT unnest(range(-2, 3)) AS o) ON true JOIN sc b ON b.entity = a.entity AND b.frame = greatest(0, least(a.n - 1, a.frame + o)) GROUP BY ALL),
        l AS (SELECT *, greatest(1, least(n, round_even(0.5::DOUBLE * n, 0)))::INT AS len FROM sm),
        w AS (SELECT a.entity, a.frame AS i, a.n, a.len, round(sum(b.score) / any_value(a.len), 9) AS mean, count(*) AS c FROM l a JOIN l b ON a.entity = b.entity AND b.frame BETWEEN a.frame AND a.frame + a.len - 1 GROUP BY ALL),
        best AS (SELECT * FROM w WHERE c = len QUALIFY row_number() OVER (PARTITION BY entity ORDER BY mean DESC, i) = 1),
        cut AS (SELECT entity, i AS f0, least(i + len, n - round_even(0.08::DOUBLE * n, 0))::INT AS f1, (n - round_even(0.08::DOUBLE * n, 0))::INT AS last FROM best),
        win AS (SELECT entity, CASE WHEN f1 - f0 < 1 THEN 0 ELSE f0 END AS f0, CASE WHEN f1 - f0 < 1 THEN greatest(1, last) ELSE f1 END AS f1 FROM cut),
        dets AS (SELECT entity, frame, value / 100 AS cx, frame % 10 / 10.0::DOUBLE AS cy, 1 - frame % 7 / 10.0::DOUBLE AS conf, 0.2::DOUBLE AS area, 0 AS pos FROM g WHERE event_type = 'purchase' UNION ALL SELECT entity, frame, 1 - value / 100, 0.3, 0.5, 0.3, 1 FROM g WHERE value > 60),
        top AS (SELECT entity, frame, cx, cy FROM dets QUALIFY row_number() OVER (PARTITION BY entity, frame ORDER BY round(conf * sqrt(area) * (0.5 + 0.5 * (1 - least(1, sqrt((cx - 0.5) ** 2 + (cy - 0.5) ** 2)))), 9) DESC, pos) = 1),
        fr AS (SELECT entity, f0, f1, unnest(range(f0::BIGINT, f1::BIGINT)) AS frame FROM win),
        o AS (SELECT fr.entity, fr.frame, axis, {_START.format(c="(0.5::DOUBLE * coalesce(CASE WHEN (fr.frame - f0) % 3 = 0 OR fr.frame = f1 - 1 THEN CASE WHEN axis = 'x' THEN cx ELSE cy END END, 0.5) + 0.25)")} AS o FROM fr JOIN cl USING (entity) LEFT JOIN top ON top.entity = fr.entity AND top.frame = fr.frame),
        md AS (SELECT entity, frame, axis, list_sort([coalesce(lag(o) OVER e, o), o, coalesce(lead(o) OVER e, o)])[2] AS m, row_number() OVER e - 1 AS i FROM o WINDOW e AS (PARTITION BY entity ORDER BY frame)),
        em AS (SELECT a.entity, a.frame, a.axis, sum(b.m * CASE WHEN b.i = 0 THEN 1 ELSE 0.3::DOUBLE END * 0.7::DOUBLE ** (a.i - b.i)) AS e FROM md a JOIN md b ON a.entity = b.entity AND b.i <= a.i GROUP BY ALL),
        hd AS (SELECT entity, frame, axis, greatest(0, least(round(e, 9), CASE WHEN axis = 'none' THEN 0 ELSE 438 END)) AS e FROM em)
        SELECT hd.entity, frame::INT AS frame, {_AT.format(a="x", o="e")} AS x, {_AT.format(a="y", o="e")} AS y, cw AS w FROM (SELECT entity, frame, hd.axis, e, cw FROM hd JOIN cl USING (entity)) hd
    """,
    "ar6_trace_arm": f"""
        WITH {SIGNAL}, {_SIZES},
        mf AS (SELECT entity, frame, value FROM s WHERE frame % 3 = 0), pf AS (SELECT entity, frame, value FROM s WHERE frame % 4 = 0 AND entity % 8 = 0), hf AS (SELECT entity, frame FROM s WHERE frame % 3 = 0 AND entity % 2 = 1),
        md AS (SELECT entity, frame, CASE WHEN entity % 5 = 0 THEN 'car' WHEN frame % 6 = 0 THEN 'person' WHEN entity % 4 = 0 THEN 'dog' ELSE 'car' END AS cls, 0.2 + value / 125 AS conf, value / 100 AS cx, (100 - value) / 100 AS cy, 0.2::DOUBLE AS area FROM mf
               UNION ALL SELECT entity, frame, CASE WHEN entity % 5 = 0 THEN 'car' ELSE 'person' END, 0.6, frame % 10 / 10.0::DOUBLE, 0.4, 0.1 FROM mf WHERE value > 70),
        pd AS (SELECT entity, frame, 'dog' AS cls, 0.5::DOUBLE AS conf, frame % 7 / 7.0::DOUBLE AS cx, 0.2::DOUBLE AS cy, 0.1::DOUBLE AS area FROM pf WHERE value > 30),
        hdt AS (SELECT entity, frame, 'person' AS cls, 0.9::DOUBLE AS conf, 0.5::DOUBLE AS cx, greatest(0.0::DOUBLE, least(1.0::DOUBLE, frame % 5 / 10.0::DOUBLE + 0.24 * 0.4)) AS cy, 0.3::DOUBLE AS area FROM hf),
        sf AS (SELECT entity, frame FROM pf UNION ALL SELECT entity, frame FROM mf WHERE entity % 8 <> 0), sd AS (SELECT * FROM pd UNION ALL SELECT * FROM md WHERE entity % 8 <> 0),
        cells AS (SELECT sf.entity, sf.frame, k.kind, axis, cls, conf, CASE WHEN axis = 'x' THEN cx ELSE cy END AS side, area FROM sf JOIN cl USING (entity) CROSS JOIN (SELECT unnest(['person', 'pet']) AS kind) k
                 LEFT JOIN sd ON sd.entity = sf.entity AND sd.frame = sf.frame AND (CASE WHEN cls IN ('cat', 'dog') THEN 'pet' ELSE cls END) = k.kind),
        per AS (SELECT entity, frame, kind, CASE WHEN count(cls) > 0 THEN greatest(0, least(1, sum(conf * area * side) / sum(conf * area))) END AS center, count(cls) AS n FROM cells GROUP BY ALL),
        has AS (SELECT entity, coalesce(bool_or(center IS NOT NULL) FILTER (kind = 'person'), false) AS p, coalesce(bool_or(center IS NOT NULL) FILTER (kind = 'pet'), false) AS t FROM per GROUP BY entity),
        pick AS (SELECT entity, CASE WHEN t AND entity % 8 = 0 THEN 'pet' WHEN p THEN 'person' WHEN t THEN 'pet' END AS kind FROM has),
        s1 AS (SELECT per.* FROM per JOIN pick USING (entity, kind)),
        hs AS (SELECT hf.entity, hf.frame, 'person' AS kind, cy AS center, 1::BIGINT AS n FROM hf JOIN hdt USING (entity, frame) JOIN cl ON cl.entity = hf.entity AND axis = 'y' JOIN pick ON pick.entity = hf.entity AND kind = 'person'),
        se AS (SELECT * FROM s1 WHERE entity NOT IN (SELECT entity FROM hs) UNION ALL SELECT * FROM hs),
        fa AS (SELECT entity, any_value(kind) AS kind, avg(n) AS clutter, avg((n = 1)::INT) AS single, quantile_cont(center, 0.5) AS median FROM se GROUP BY entity),
        how AS (SELECT cl.entity, axis, cw, median, CASE WHEN kind IS NULL OR axis = 'none' OR (NOT (kind = 'pet' OR (axis = 'y' AND kind = 'person')) AND clutter > 0.9) THEN 'base' WHEN kind = 'pet' OR single >= 0.3 THEN 'trace' ELSE 'const' END AS how FROM cl LEFT JOIN fa USING (entity)),
        num AS (SELECT entity, frame, center, row_number() OVER (PARTITION BY entity ORDER BY frame) - 1 AS i FROM se WHERE entity IN (SELECT entity FROM how WHERE how = 'trace')),
        {_between("num", "i", "center", "nb")}, fl AS (SELECT entity, frame, i, {_FILLED.format(a="a", b="b", fa="fa", fb="fb", f="i")} AS c, count(*) OVER (PARTITION BY entity) AS m FROM nb),
        sm AS (SELECT x.entity, x.frame, CASE WHEN x.m < 3 THEN any_value(x.c) ELSE avg(y.c) END AS c FROM fl x JOIN (SELECT unnest([-1, 0, 1]) AS o) ON true JOIN fl y ON y.entity = x.entity AND y.i = greatest(0, least(x.m - 1, x.i + o)) GROUP BY x.entity, x.frame, x.m),
        base AS (SELECT entity, unnest(range(n - round_even(0.08::DOUBLE * n, 0)::BIGINT)) AS frame FROM cl),
        mix AS (SELECT entity, frame, c, b.frame IS NOT NULL AS wanted FROM (SELECT * FROM base WHERE entity IN (SELECT entity FROM how WHERE how = 'trace')) b FULL JOIN sm USING (entity, frame)),
        {_between("mix", "frame", "c", "mb")}, tr AS (SELECT entity, frame, {_FILLED.format(a="a", b="b", fa="fa", fb="fb", f="frame")} AS moving FROM mb WHERE wanted),
        bx AS (SELECT base.entity, base.frame, how, axis, cw, {_START.format(c="CASE how WHEN 'base' THEN 0.5 WHEN 'trace' THEN round(moving, 9) ELSE round(median, 9) END")} AS o FROM base JOIN how USING (entity) LEFT JOIN tr ON tr.entity = base.entity AND tr.frame = base.frame),
        tg AS (SELECT entity, frame FROM md WHERE cls IN ('person', 'cat', 'dog') AND conf >= 0.3 UNION SELECT entity, frame FROM pd WHERE conf >= 0.3),
        sl AS (SELECT entity, frame, frame // 2 AS i, 1 - value / 100 >= 0.5 AND value <= 60 AND (entity, frame) NOT IN (SELECT (entity, frame) FROM tg) AS slate, count(*) OVER (PARTITION BY entity) AS m FROM s WHERE frame % 2 = 0),
        sn AS (SELECT entity, i, m, lag(i) OVER (PARTITION BY entity ORDER BY i) AS before, lead(i) OVER (PARTITION BY entity ORDER BY i) AS after FROM sl WHERE slate),
        sg AS (SELECT *, max(CASE WHEN i - coalesce(before, -1) > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY entity ORDER BY i) AS c0, max(CASE WHEN coalesce(after, m) - i > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY entity ORDER BY i DESC) AS c1 FROM sn),
        ed AS (SELECT entity, max(i) FILTER (c0 = 0) AS h, min(i) FILTER (c1 = 0) AS t FROM sg GROUP BY entity),
        dr AS (SELECT bx.*, coalesce(bx.frame // 2 <= h, false) OR coalesce(bx.frame // 2 >= t, false) AS gone FROM bx LEFT JOIN ed USING (entity)),
        kept AS (SELECT * FROM dr QUALIFY NOT gone OR count(*) FILTER (gone) OVER (PARTITION BY entity) > 0.5 * count(*) OVER (PARTITION BY entity))
        SELECT entity, frame::INT AS frame, {_AT.format(a="x", o="o")} AS x, {_AT.format(a="y", o="o")} AS y, cw AS w, how FROM kept
    """,
    "ar8_gate_study": f"""
        WITH dets AS (SELECT l_suppkey AS entity, l_linenumber AS frame, 1 - l_discount * 5 AS conf, l_quantity / 50 AS area, (l_partkey % 1000) / 1000.0::DOUBLE AS c FROM lineitem), {_CLIPS}, {_TRUTH},
        pooled AS (SELECT entity, frame, greatest(0.0, least(1.0, sum(conf * area * c) / sum(conf * area))) AS center, count(*) AS n FROM dets GROUP BY ALL HAVING sum(conf * area) > 0),
        e AS (SELECT entity, width, quantile_cont(center, 0.5) AS m, avg(n) AS clutter FROM clips LEFT JOIN pooled USING (entity) GROUP BY ALL),
        cs AS (SELECT 'hard' AS rule, v AS "value", entity, width, CASE WHEN m IS NULL OR clutter > v THEN 0.5 ELSE m END AS c FROM e, (SELECT unnest({CUTS})::DOUBLE AS v) UNION ALL SELECT 'soft', v, entity, width, coalesce(0.5 + (m - 0.5) * exp(-clutter / v), 0.5) FROM e, (SELECT unnest({SOFTNESS})::DOUBLE AS v)),
        boxes AS (SELECT rule, "value", entity, fr.frame, {_X.format(c="c")} AS x FROM cs, range(7) fr(frame)), {_f1("boxes", 'rule, value')}
        SELECT rule, "value", round(avg(f1), 6) AS f1 FROM f1s GROUP BY ALL
    """,
    "ar12_reassembled": f"""
        WITH {SIGNAL}, {_SIZES}, fr AS (SELECT entity, cw, unnest(range(n - round_even(0.08::DOUBLE * n, 0)::BIGINT)) AS frame FROM cl)
        SELECT entity::VARCHAR AS video_id, 5.0::DOUBLE AS model_size_mb, entity % 2 = 0 AS swapped, count(*) FILTER (entity % 2 = 1 OR frame % 5 = 0) AS n, coalesce(sum(frame + cw) FILTER (entity % 2 = 1 OR frame % 5 = 0), 0)::BIGINT AS total FROM fr GROUP BY entity
    """,
    "pr12_head_centers": f"""
        WITH {SIGNAL} SELECT entity, frame, pos::INT AS pos, CASE WHEN event_type = 'purchase' THEN 'person' ELSE 'dog' END AS cls, 0.5::DOUBLE AS cx,
               round(CASE WHEN event_type = 'purchase' AND frame % 3 <> 0 AND frame % 4 <> 0 THEN greatest(0, least(1, frame % 5 / 4.0::DOUBLE + 0.24::DOUBLE * 0.4)) ELSE value / 100 END, 6) AS cy FROM s, range(2) p(pos)
    """,
}
