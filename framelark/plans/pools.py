"""Queries of joins, pools, tracks and reports, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gates, match, pool, report, score, tracks, trials
from ..sources import frames as src
from ._base import DETS, META, SIGNAL, rounded


def _scores(s, d):
    return score.score_entities(src.boxes(s, d, "F"), src.boxes(s, d, "O"))


def _entries(s, d):
    """Lines as entries of their supplier's tracks: the line number is the track, the order the frame."""
    li = src.table(s, d, "lineitem")
    return li.select(F.col("l_suppkey").alias("entity"), F.col("l_linenumber").alias("track"), F.col("l_orderkey").alias("frame"), (F.col("l_partkey") % 1000 / 1000.0).alias("c"), (F.col("l_quantity") / 50).alias("area"), (1 - F.col("l_discount") * 5).alias("conf"), F.col("l_returnflag").alias("cls"), F.struct("l_partkey", "l_extendedprice", "l_shipdate").alias("pos"), (1 - F.col("l_tax")).alias("iou"))


def _masks(s, d):
    return _entries(s, d).withColumn("frame", F.col("track")).withColumn("x0", F.col("c") - F.col("area") / 4).withColumn("x1", F.col("c") + F.col("area") / 4)


def _run(s, d, skip):
    li = src.table(s, d, "lineitem").where(F.col("l_partkey") % 3 != skip)
    return li.groupBy(F.col("l_orderkey").alias("entity"), F.col("l_linenumber").alias("frame")).agg(F.min("l_partkey").alias("x"))


def _truth(s, d):
    """One span a supplier and line number: the middle of its detections, a quarter wide."""
    return src.detections(s, d).groupBy("entity", "frame").agg(F.min("c").alias("lo")).withColumn("hi", F.col("lo") + 0.02)


def _signal(s, d):
    return src.signal(s, d)


def _purchases(s, d):
    return _signal(s, d).where("event_type = 'purchase'").select("entity", "frame", F.col("value").alias("y"))


def _span(s, d):
    return _signal(s, d).where("event_type = 'purchase'").groupBy("entity").agg(F.min("frame").alias("start"), F.max("frame").alias("end"))


def _fused(only=None):
    return lambda s, d: rounded(tracks.fused_centers(_entries(s, d), "pres*area", only))


def _customers(s, d):
    return src.table(s, d, "customer").select("c_custkey", "c_mktsegment")


def _top(s, d, column):
    o = src.table(s, d, "orders").where(F.col("o_orderstatus") == column)
    return o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("price"))


def _arms(s, d):
    """Two arms of one score: f1 and a weaker one."""
    return _scores(s, d).select("entity", "f1", (F.col("matched") / (F.col("n_pred") + F.col("n_truth"))).alias("other"))


QUERIES = {
    "ag3_index_quantiles": lambda s, d: rounded(report.index_quantiles(_scores(s, d), "f1")),
    "ag4_totals": lambda s, d: rounded(report.totals(_scores(s, d))),
    "or1_report_order": lambda s, d: rounded(report.placed(_scores(s, d).select("entity", F.when(F.col("matched") > 0, F.round("f1", 9)).alias("f1")), F.col("f1"), [F.col("f1").asc_nulls_last(), "entity"])),
    "or2_numeric_first": lambda s, d: report.placed(src.table(s, d, "supplier").select(F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).otherwise(F.col("s_suppkey").cast("string")).alias("id")), report.numeric_first("id")[0], report.numeric_first("id")),
    "or3_samples": lambda s, d: pool.pick_frames(src.detections(s, d).withColumn("frame", F.col("cls")), ["l_orderkey", "l_extendedprice", "c"]).select("entity", "cls", "l_orderkey"),
    "or5_top_by_area": lambda s, d: rounded(tracks.mask_centers(_masks(s, d), 3).select("entity", "frame", "largest", "area_w")),
    "or6_worst": lambda s, d: rounded(report.placed(_scores(s, d).select("entity", F.round("f1", 9).alias("f1")), F.col("f1"), ["f1", "entity"]).where("place <= 10")),
    "or7_round_robin": lambda s, d: report.round_robin([(report.placed(src.table(s, d, "supplier"), -F.col("s_acctbal"), [F.col("s_acctbal").desc(), "s_suppkey"]), "s_suppkey"), (report.placed(src.table(s, d, "supplier"), F.col("s_nationkey"), ["s_nationkey", "s_suppkey"]), "s_suppkey")], 12),
    "or8_spread_sample": lambda s, d: report.spread_sample(src.table(s, d, "customer").select("c_custkey"), F.col("c_custkey"), ["c_custkey"], 6),
    "or10_track_series": lambda s, d: _entries(s, d).groupBy("entity", "track").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("frame", "pos", "c"))), lambda x: x["frame"].cast("string")), ",").alias("frames")),
    "jn3_metadata_fallback": lambda s, d: match.first_of(_customers(s, d), [_top(s, d, "F"), _top(s, d, "O")], "c_custkey", "price"),
    "jn4_triple": lambda s, d: rounded(_scores(s, d).join(src.meta(s, d), "entity").join(src.table(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("entity"), "o_totalprice"), "entity").select("entity", "f1", "w", "o_totalprice")),
    "jn6_orders_without_lines": lambda s, d: src.resume(src.table(s, d, "orders").select("o_orderkey"), src.table(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct(), "o_orderkey"),
    "jn8_asof": lambda s, d: rounded(match.sample_at(_signal(s, d), _purchases(s, d)).select("entity", "frame", "asof")),
    "jn9_nearest": lambda s, d: rounded(match.sample_at(_signal(s, d), _purchases(s, d)).select("entity", "frame", "nearest", "distance")),
    "jn10_interval": lambda s, d: match.in_interval(_signal(s, d).select("entity", "frame"), _span(s, d)),
    "iv12_interval_or_all": lambda s, d: match.in_interval(_signal(s, d).select("entity", "frame"), _span(s, d).where("start > 2"), 0.5),
    "jn11_spatial": lambda s, d: rounded(match.containing(src.detections(s, d).select("entity", "frame", "c", "l_orderkey", "l_extendedprice"), _truth(s, d).select("entity", "lo", "hi", F.col("frame").alias("name")), F.col("c")).groupBy("entity", "name").agg(F.count(F.lit(1)).alias("n"))),
    "jn12_semi": lambda s, d: _signal(s, d).select("entity", "frame").join(_purchases(s, d), ["entity", "frame"], "left_semi"),
    "jn14_source_switch": lambda s, d: match.switch(_customers(s, d), F.col("c_mktsegment") == "BUILDING", _top(s, d, "F"), _top(s, d, "O"), "c_custkey", "price"),
    "jn15_either": lambda s, d: match.either(*(src.table(s, d, "lineitem").where(F.col("l_linestatus") == x).select(F.col("l_orderkey").alias("entity"), F.col("l_linenumber").alias("frame"), (F.col("l_quantity") > q).alias("have")) for x, q in (("F", 40), ("O", 45))), ["entity", "frame"], "have"),
    "jn16_manifest": lambda s, d: match.with_reason(src.table(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_custkey")).alias("c_custkey")), src.table(s, d, "customer").where("c_acctbal > 0").select("c_custkey", "c_name"), "c_custkey").select("o_orderkey", "c_name", "miss"),
    "jn18_raster": lambda s, d: rounded(match.raster_cover(*((lambda b: (b.groupBy("entity", "frame").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")), b))(_boxes(s, d))), 8)),
    "ag6_track_weighted": _fused(),
    "ag36_person_tracks": _fused("R"),
    "ag8_clutter": lambda s, d: rounded(pool.clutter(src.table(s, d, "orders").select(F.col("o_custkey").alias("entity"), F.col("o_orderkey").alias("frame")), src.table(s, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("frame")))),
    "ag11_extent": lambda s, d: rounded(tracks.mask_centers(_masks(s, d)).select("entity", "frame", "extent")),
    "ag12_mask_rules": lambda s, d: rounded(tracks.mask_centers(_masks(s, d)).drop("extent", "largest")),
    "ag13_track_stats": lambda s, d: rounded(tracks.track_stats(_entries(s, d))),
    "ag14_pick_main": lambda s, d: _each_rule(tracks.track_stats(_entries(s, d))),
    "ag15_class_histogram": lambda s, d: src.detections(s, d).groupBy("cls").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "cls").limit(5),
    "ag16_frame_counts": lambda s, d: rounded(src.detections(s, d).groupBy("entity", "frame").agg(F.count_if(F.col("cls") == "R").alias("n_person"), F.count_if(F.col("cls") == "A").alias("n_pet"), F.sum(F.when(F.col("cls") == "R", F.col("conf")).otherwise(0.0)).alias("conf"))),
    "ag17_moments": lambda s, d: rounded(_signal(s, d).groupBy("entity").agg(F.stddev_pop("value").alias("sd"), F.avg("value").alias("mean"), F.percentile("value", F.lit(0.5)).alias("median"), F.min("value").alias("least"), F.max("value").alias("most"))),
    "ag19_buckets": lambda s, d: rounded(report.bucket_report(match.coverage(_truth(s, d), src.detections(s, d).where("cls = 'R'")), report.levels("coverage", [(0.8, "clean"), (0.2, "partial")], "broken"), ["coverage"])),
    "ag20_win_loss": lambda s, d: rounded(report.win_loss(_arms(s, d).withColumn("delta", F.col("f1") - F.col("other") + F.when(F.col("entity") % 2 == 0, -0.1).otherwise(0.0)), "delta")),
    "ag22_offsets": lambda s, d: rounded(_run(s, d, 0).join(_run(s, d, 1).withColumnRenamed("x", "z"), ["entity", "frame"]).withColumn("off", F.abs(F.col("x") - F.col("z")).cast("double")).groupBy("entity").agg(F.avg("off").alias("mean"), F.percentile("off", F.lit(0.5)).alias("median"), F.max("off").alias("most"))),
    "ag22_p90": lambda s, d: rounded(report.index_quantiles(score.compare_runs(_run(s, d, 0), _run(s, d, 1)), "mean_offset", (0.5, 0.9))),
    "ag23_verdict": lambda s, d: rounded(report.run_verdict(score.compare_runs(_run(s, d, 0), _run(s, d, 1)).withColumn("width", F.lit(169.0)))),
    "ag24_dice": lambda s, d: rounded(report.dice(_run(s, d, 0), _run(s, d, 1))),
    "se1_set_counts": lambda s, d: report.set_counts(_run(s, d, 0), _run(s, d, 1)),
    "ag25_coverage": lambda s, d: rounded(match.coverage(_truth(s, d), src.detections(s, d).where("cls = 'R'"))),
    "ag26_switch_rate": lambda s, d: rounded(pool.switch_rate(_signal(s, d), "event_type")),
    "ag27_top_share": lambda s, d: rounded(report.top_share_mean(_scores(s, d).withColumn("f1", F.round("f1", 9)), F.col("n_pred"), "f1", [0.25, 0.5], ["entity"])),
    "ag28_tau": lambda s, d: rounded(report.index_quantiles(_scores(s, d).join(src.meta(s, d), "entity").withColumn("tau", F.col("n_truth") / F.col("n_frames")), "tau")),
    "ag31_distinct": lambda s, d: src.detections(s, d).agg(F.count_distinct("entity").alias("entities"), F.count_distinct("entity", "frame").alias("frames"), F.count_distinct("area").alias("sizes")),
    "ag32_oracle": lambda s, d: rounded(_arms(s, d).agg(F.avg("f1").alias("a"), F.avg("other").alias("b"), F.avg(F.greatest("f1", "other")).alias("oracle"))),
    "ag34_subject_priority": lambda s, d: rounded(tracks.subject_priority(*(pool.pool_frames(src.detections(s, d).withColumn("entity", F.col("l_orderkey")).where(F.col("cls") == x)).drop("n") for x in ("R", "A")), ("person", "pet"))),
    "ag35_argmax_series": lambda s, d: rounded(tracks.argmax_series(src.table(s, d, "orders").select(F.col("o_orderkey").alias("entity"), F.explode(F.sequence(F.lit(1), F.lit(7))).alias("frame")), src.detections(s, d).withColumn("entity", F.col("l_orderkey")).where("cls = 'R'"), F.round(F.col("conf") * F.sqrt("area"), 9), ["c", "l_extendedprice"])),
    "ag37_person_frames": lambda s, d: rounded(pool.pool_frames(src.detections(s, d).where("cls = 'R' AND conf >= 0.2"))),
    "ag38_median_or_half": lambda s, d: rounded(src.table(s, d, "orders").select(F.col("o_orderkey").alias("entity")).join(pool.entity_centers(pool.pool_frames(src.detections(s, d).withColumn("entity", F.col("l_orderkey")).where("cls = 'R'"))), "entity", "left").select("entity", F.coalesce("median", F.lit(0.5)).alias("center"))),
}


def _boxes(s, d):
    return src.detections(s, d).select(F.col("l_orderkey").alias("entity"), F.lit(0).alias("frame"), (F.col("c") * 10).alias("x0"), (F.col("conf") * 3).alias("y0"), (F.col("c") * 10 + F.col("area") * 3).alias("x1"), (F.col("conf") * 3 + F.col("area") * 2).alias("y1"))


def _each_rule(stats):
    out = None
    for r in tracks.TRACK_RULES:
        one = tracks.pick_main(stats, r).withColumn("rule", F.lit(r))
        out = one if out is None else out.unionByName(one)
    return rounded(out)


_BOXES = "SELECT l_orderkey AS entity, l_linenumber AS frame, min(l_partkey % 200)::DOUBLE AS x FROM lineitem WHERE l_linestatus = '{}' GROUP BY ALL"
_SCORES = f"""
    p AS ({_BOXES.format("F")}), t AS ({_BOXES.format("O")}),
    m AS (SELECT entity, frame, greatest(0, least(p.x + 169, t.x + 169) - greatest(p.x, t.x)) * 300.0 AS i FROM p JOIN t USING (entity, frame)),
    u AS (SELECT entity, frame, CASE WHEN i > 0 THEN i / (2 * 169 * 300 - i) ELSE 0 END AS iou FROM m),
    scores AS (
        SELECT entity, coalesce(np, 0) AS n_pred, nt AS n_truth, coalesce(mm, 0) AS matched, coalesce(si, 0.0) AS sum_iou, 2 * coalesce(si, 0.0) / (coalesce(np, 0) + nt) AS f1
        FROM (SELECT entity, count(*) AS nt FROM t GROUP BY entity)
        LEFT JOIN (SELECT entity, count(*) AS np FROM p GROUP BY entity) USING (entity)
        LEFT JOIN (SELECT entity, count(*) AS mm, sum(iou) AS si FROM u GROUP BY entity) USING (entity))
"""
_ENTRIES = "e AS (SELECT l_suppkey AS entity, l_linenumber AS track, l_orderkey AS frame, l_partkey % 1000 / 1000.0::DOUBLE AS c, l_quantity / 50 AS area, 1 - l_discount * 5 AS conf, l_returnflag AS cls, l_partkey, l_extendedprice, l_shipdate, 1 - l_tax AS iou FROM lineitem)"
_STATS = f"{_ENTRIES}, st AS (SELECT entity, track, count(*) AS n, avg(area) AS mean_area, sum(area) AS sum_area, max(area) AS max_area, avg(conf) AS mean_conf, first(cls ORDER BY frame, l_partkey, l_extendedprice, l_shipdate) AS first_cls, count(*) / any_value(k) AS presence FROM e JOIN (SELECT entity, count(DISTINCT frame) AS k FROM e GROUP BY 1) USING (entity) GROUP BY ALL)"
_FUSED = f"WITH {_STATS} SELECT entity, frame, round(greatest(0, least(1, sum(presence * mean_area * c) / sum(presence * mean_area))), 6) AS center FROM e JOIN st USING (entity, track) WHERE presence * mean_area > 0 {{}} GROUP BY ALL"
_RUNS2 = "a AS (SELECT l_orderkey AS entity, l_linenumber AS frame, min(l_partkey) AS ax FROM lineitem WHERE l_partkey % 3 <> 0 GROUP BY ALL), b AS (SELECT l_orderkey AS entity, l_linenumber AS frame, min(l_partkey) AS bx FROM lineitem WHERE l_partkey % 3 <> 1 GROUP BY ALL)"
_CMP = f"{_RUNS2}, cmp AS (SELECT entity, count(ax + bx) / count(*) AS jaccard, avg(abs(ax - bx)) AS mean_offset, count(ax) AS na, count(bx) AS nb, count(ax + bx) AS ab, count(*) AS n FROM a FULL JOIN b USING (entity, frame) GROUP BY entity)"
_COVER = f"{DETS}, tr AS (SELECT entity, frame, min(c) AS lo, min(c) + 0.02 AS hi FROM dets GROUP BY ALL), each AS (SELECT tr.entity, tr.frame, coalesce(bool_or(c BETWEEN lo AND hi), false) AS hit FROM tr LEFT JOIN (SELECT * FROM dets WHERE cls = 'R') d ON d.entity = tr.entity AND d.frame = tr.frame GROUP BY ALL), cov AS (SELECT entity, count(*) AS n, avg(hit::INT) AS coverage FROM each GROUP BY entity)"
_PURCH = f"{SIGNAL}, y AS (SELECT s.entity, s.frame, CASE WHEN event_type = 'purchase' THEN value END AS y, CASE WHEN event_type = 'purchase' THEN frame END AS pos FROM s), w AS (SELECT entity, frame, last_value(pos IGNORE NULLS) OVER b AS pf, last_value(y IGNORE NULLS) OVER b AS p, first_value(pos IGNORE NULLS) OVER a AS nf, first_value(y IGNORE NULLS) OVER a AS n FROM y WINDOW b AS (PARTITION BY entity ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY entity ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"
_SPAN = f"{SIGNAL}, sp AS (SELECT entity, min(frame) AS a, max(frame) AS b FROM s WHERE event_type = 'purchase' GROUP BY 1)"
_TOPS = "f AS (SELECT o_custkey, max(o_totalprice) AS p FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), o AS (SELECT o_custkey, max(o_totalprice) AS p FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)"
_MASK = f"{_ENTRIES}, k AS (SELECT *, c - area / 4 AS x0, c + area / 4 AS x1, row_number() OVER (PARTITION BY entity, track ORDER BY area DESC, l_partkey, l_extendedprice, l_shipdate) AS place FROM e)"
_ORDERPOOL = f"{DETS}, op AS (SELECT l_orderkey AS entity, frame, cls, greatest(0.0, least(1.0, sum(conf * area * c) / sum(conf * area))) AS center FROM dets WHERE cls IN ('R', 'A') GROUP BY ALL HAVING sum(conf * area) > 0)"


def _quantile(value, q):
    return f"round(list_sort(list({value}))[least(floor(count({value}) * {q})::INT, count({value})::INT - 1) + 1], 6) AS q{round(q * 100)}"


ORACLE_SQL = {
    "ag3_index_quantiles": f"WITH {_SCORES} SELECT {_quantile('f1', 0.25)}, {_quantile('f1', 0.5)}, {_quantile('f1', 0.75)} FROM scores WHERE f1 IS NOT NULL",
    "ag4_totals": f"WITH {_SCORES} SELECT sum(n_truth)::BIGINT AS n_truth, sum(n_pred)::BIGINT AS n_pred, sum(matched)::BIGINT AS matched, round(sum(n_pred) / sum(n_truth), 6) AS k, round(sum(matched) / sum(n_truth), 6) AS recall, round(sum(matched) / sum(n_pred), 6) AS precision, round(sum(sum_iou) / sum(matched), 6) AS mean_iou FROM scores",
    "or1_report_order": f"WITH {_SCORES} SELECT entity, round(f, 6) AS f1, row_number() OVER (ORDER BY f NULLS LAST, entity) AS place FROM (SELECT entity, CASE WHEN matched > 0 THEN round(f1, 9) END AS f FROM scores)",
    "or2_numeric_first": "WITH i AS (SELECT CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE s_suppkey::VARCHAR END AS id FROM supplier) SELECT id, row_number() OVER (ORDER BY coalesce(try_cast(id AS BIGINT), 9223372036854775807), id) AS place FROM i",
    "or3_samples": f"WITH {DETS} SELECT entity, cls, l_orderkey FROM dets QUALIFY row_number() OVER (PARTITION BY entity, cls ORDER BY l_orderkey, l_extendedprice, c) = 1",
    "or5_top_by_area": f"WITH {_MASK} SELECT entity, track AS frame, round(first(c ORDER BY place), 6) AS largest, round(sum(area * c) / sum(area), 6) AS area_w FROM k WHERE place <= 3 GROUP BY ALL",
    "or6_worst": f"WITH {_SCORES} SELECT entity, round(f, 6) AS f1, row_number() OVER (ORDER BY f, entity) AS place FROM (SELECT entity, round(f1, 9) AS f FROM scores) QUALIFY place <= 10",
    "or7_round_robin": "WITH l AS (SELECT s_suppkey AS key, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS p, 0 AS l FROM supplier UNION ALL SELECT s_suppkey, row_number() OVER (ORDER BY s_nationkey, s_suppkey), 1 FROM supplier), o AS (SELECT key, min(p * 2 + l) AS m FROM l WHERE p <= 12 GROUP BY key) SELECT key, row_number() OVER (ORDER BY m, key) AS turn FROM o QUALIFY turn <= 12",
    "or8_spread_sample": "SELECT c_custkey FROM customer QUALIFY (row_number() OVER (ORDER BY c_custkey) - 1) % greatest(1, count(*) OVER () // 24) = 0",
    "or10_track_series": f"WITH {_ENTRIES} SELECT entity, track, string_agg(frame::VARCHAR, ',' ORDER BY frame) AS frames FROM e GROUP BY ALL",
    "jn3_metadata_fallback": f"WITH {_TOPS} SELECT c_custkey, c_mktsegment, coalesce(f.p, o.p) AS price, CASE WHEN f.p IS NOT NULL THEN 0 WHEN o.p IS NOT NULL THEN 1 END AS source FROM customer LEFT JOIN f ON f.o_custkey = c_custkey LEFT JOIN o ON o.o_custkey = c_custkey",
    "jn4_triple": f"WITH {META}, {_SCORES} SELECT entity, round(f1, 6) AS f1, w, round(o_totalprice, 6) AS o_totalprice FROM scores JOIN meta USING (entity) JOIN orders ON o_orderkey = entity AND o_orderstatus = 'F'",
    "jn6_orders_without_lines": "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
    "jn8_asof": f"WITH {_PURCH} SELECT entity, frame, round(coalesce(p, n), 6) AS asof FROM w",
    "jn9_nearest": f"WITH {_PURCH} SELECT entity, frame, round(CASE WHEN p IS NULL OR nf - frame < frame - pf THEN n ELSE p END, 6) AS nearest, CASE WHEN p IS NULL OR nf - frame < frame - pf THEN nf - frame ELSE frame - pf END AS distance FROM w",
    "jn10_interval": f"WITH {_SPAN} SELECT entity, frame FROM s LEFT JOIN sp USING (entity) QUALIFY coalesce(b > a AND frame >= a AND frame < b, false) OR NOT bool_or(coalesce(b > a AND frame >= a AND frame < b, false)) OVER (PARTITION BY entity)",
    "iv12_interval_or_all": f"WITH {_SPAN}, j AS (SELECT s.entity, frame, coalesce(b > a AND frame >= (a + b) / 2 - (b - a) / 4 AND frame < (a + b) / 2 + (b - a) / 4, false) AS hit FROM s LEFT JOIN (SELECT * FROM sp WHERE a > 2) sp USING (entity)) SELECT entity, frame FROM j QUALIFY hit OR NOT bool_or(hit) OVER (PARTITION BY entity)",
    "jn11_spatial": f"WITH {_COVER} SELECT dets.entity, tr.frame AS name, count(*) AS n FROM dets JOIN tr ON tr.entity = dets.entity AND c BETWEEN lo AND hi GROUP BY ALL",
    "jn12_semi": f"WITH {SIGNAL} SELECT entity, frame FROM s WHERE event_type = 'purchase'",
    "jn14_source_switch": f"WITH {_TOPS} SELECT c_custkey, c_mktsegment, CASE WHEN c_mktsegment = 'BUILDING' THEN coalesce(f.p, o.p) ELSE o.p END AS price FROM customer LEFT JOIN f ON f.o_custkey = c_custkey LEFT JOIN o ON o.o_custkey = c_custkey",
    "jn15_either": "SELECT l_orderkey AS entity, l_linenumber AS frame, bool_or(l_quantity > CASE l_linestatus WHEN 'F' THEN 40 ELSE 45 END) AS have FROM lineitem WHERE l_linestatus IN ('F', 'O') GROUP BY ALL",
    "jn16_manifest": "SELECT o_orderkey, c_name, CASE WHEN o_orderpriority = '5-LOW' THEN 'no name' WHEN c_name IS NULL THEN 'not found' END AS miss FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_orderpriority <> '5-LOW' AND c_custkey = o_custkey",
    "jn18_raster": f"WITH {DETS}, bx AS (SELECT l_orderkey AS entity, c * 10 AS x0, conf * 3 AS y0, c * 10 + area * 3 AS x1, conf * 3 + area * 2 AS y1 FROM dets), sp AS (SELECT entity, min(x0) AS a, min(y0) AS b, max(x1) AS c, max(y1) AS d FROM bx GROUP BY 1), pt AS (SELECT entity, i, j, a + (c - a) * i / 7 AS x, b + (d - b) * j / 7 AS y FROM sp, range(8) u(i), range(8) v(j)), hit AS (SELECT pt.entity, i, j, bool_or(x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1) AS h FROM pt JOIN bx ON bx.entity = pt.entity GROUP BY ALL) SELECT entity, 0 AS frame, round(count(*) FILTER (h) / 64, 6) AS cover FROM hit GROUP BY entity",
    "ag6_track_weighted": _FUSED.format(""),
    "ag36_person_tracks": _FUSED.format("AND first_cls = 'R'"),
    "ag8_clutter": "WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT o_custkey AS entity, round(avg(coalesce(n, 0)), 6) AS clutter, count(*) AS n_frames FROM orders LEFT JOIN n ON l_orderkey = o_orderkey GROUP BY 1",
    "ag11_extent": f"WITH {_MASK} SELECT entity, track AS frame, round((min(x0) + max(x1)) / 2, 6) AS extent FROM k GROUP BY ALL",
    "ag12_mask_rules": f"WITH {_MASK} SELECT entity, track AS frame, round(sum(area * c) / sum(area), 6) AS area_w, round(sum(sqrt(area) * c) / sum(sqrt(area)), 6) AS sqrt_area_w, round(sum(area * iou * c) / sum(area * iou), 6) AS iou_area_w, round(sum(iou * c) / sum(iou), 6) AS iou_w FROM k GROUP BY ALL",
    "ag13_track_stats": f"WITH {_STATS} SELECT entity, track, n, round(mean_area, 6) AS mean_area, round(sum_area, 6) AS sum_area, round(max_area, 6) AS max_area, round(mean_conf, 6) AS mean_conf, first_cls, round(presence, 6) AS presence FROM st",
    "ag14_pick_main": f"WITH {_STATS}, r AS (" + " UNION ALL ".join(f"SELECT entity, track, '{n}' AS rule, round({x}, 9) AS score FROM st" for n, x in (("pres*area", "presence * mean_area"), ("pres*maxarea", "presence * max_area"), ("integrated", "sum_area"), ("presence", "presence"), ("meanarea", "mean_area"), ("pres*area*conf", "presence * mean_area * mean_conf"))) + ") SELECT entity, track, rule, round(score, 6) AS score FROM r QUALIFY row_number() OVER (PARTITION BY entity, rule ORDER BY r.score DESC, track) = 1",
    "ag15_class_histogram": f"WITH {DETS} SELECT cls, count(*) AS n FROM dets GROUP BY cls ORDER BY n DESC, cls LIMIT 5",
    "ag16_frame_counts": f"WITH {DETS} SELECT entity, frame, count(*) FILTER (cls = 'R') AS n_person, count(*) FILTER (cls = 'A') AS n_pet, round(coalesce(sum(conf) FILTER (cls = 'R'), 0), 6) AS conf FROM dets GROUP BY ALL",
    "ag17_moments": f"WITH {SIGNAL} SELECT entity, round(stddev_pop(value), 6) AS sd, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(min(value), 6) AS least, round(max(value), 6) AS most FROM s GROUP BY entity",
    "ag19_buckets": f"WITH {_COVER}, b AS (SELECT *, CASE WHEN coverage >= 0.8 THEN 'clean' WHEN coverage >= 0.2 THEN 'partial' ELSE 'broken' END AS bucket FROM cov) SELECT bucket, count(*) AS n, round(avg(coverage), 6) AS coverage FROM b GROUP BY bucket UNION ALL SELECT 'ALL', count(*), round(avg(coverage), 6) FROM b",
    "ag20_win_loss": f"WITH {_SCORES}, dl AS (SELECT f1 - matched / (n_pred + n_truth) + CASE WHEN entity % 2 = 0 THEN -0.1::DOUBLE ELSE 0 END AS d FROM scores) SELECT count(*) FILTER (d > 1e-9) AS wins, count(*) FILTER (d < -1e-9) AS losses, count(*) FILTER (abs(d) <= 1e-9) AS ties, round(avg(d), 6) AS mean, round(stddev_samp(d) / sqrt(count(d)), 6) AS se FROM dl",
    "ag22_offsets": f"WITH {_RUNS2} SELECT entity, round(avg(abs(ax - bx)), 6) AS mean, round(quantile_cont(abs(ax - bx)::DOUBLE, 0.5), 6) AS median, max(abs(ax - bx))::DOUBLE AS most FROM a JOIN b USING (entity, frame) GROUP BY entity",
    "ag22_p90": f"WITH {_CMP} SELECT {_quantile('mean_offset', 0.5)}, {_quantile('mean_offset', 0.9)} FROM cmp WHERE mean_offset IS NOT NULL",
    "ag23_verdict": f"WITH {_CMP}, v AS (SELECT avg(jaccard) AS j, quantile_cont(mean_offset, 0.5) AS o FROM cmp) SELECT round(j, 6) AS jaccard, round(o, 6) AS \"offset\", round(o / 169, 6) AS relative, CASE WHEN j < 0.9 THEN 'REAL' WHEN j < 0.98 THEN 'MINOR' WHEN o / 169 >= 0.05 THEN 'BOX-ONLY' ELSE 'LABEL NOISE' END AS verdict FROM v",
    "ag24_dice": f"WITH {_CMP} SELECT entity, round(2 * ab / (na + nb), 6) AS dice FROM cmp",
    "se1_set_counts": f"WITH {_CMP} SELECT entity, ab AS \"both\", na - ab AS only_a, nb - ab AS only_b, n AS either FROM cmp",
    "ag25_coverage": f"WITH {_COVER} SELECT entity, n, round(coverage, 6) AS coverage FROM cov",
    "ag26_switch_rate": f"WITH {SIGNAL} SELECT entity, count(*) - 1 AS n, round(avg((event_type <> before)::INT), 6) AS rate FROM (SELECT *, lag(event_type) OVER (PARTITION BY entity ORDER BY frame) AS before FROM s) GROUP BY entity",
    "ag27_top_share": f"WITH {_SCORES}, r AS (SELECT round(f1, 9) AS f, row_number() OVER (ORDER BY n_pred DESC, entity) AS p, count(*) OVER () AS n FROM scores) SELECT share, count(*) AS n, round(avg(f), 6) AS mean FROM r, (SELECT unnest([0.25, 0.5])::DOUBLE AS share) WHERE p <= round_even(share * n, 0) GROUP BY share",
    "ag28_tau": f"WITH {_SCORES}, ta AS (SELECT n_truth / 8 AS tau FROM scores JOIN orders ON o_orderkey = entity) SELECT {_quantile('tau', 0.25)}, {_quantile('tau', 0.5)}, {_quantile('tau', 0.75)} FROM ta",
    "ag31_distinct": f"WITH {DETS} SELECT count(DISTINCT entity) AS entities, count(DISTINCT (entity, frame)) AS frames, count(DISTINCT area) AS sizes FROM dets",
    "ag32_oracle": f"WITH {_SCORES}, x AS (SELECT f1, matched / (n_pred + n_truth) AS o FROM scores) SELECT round(avg(f1), 6) AS a, round(avg(o), 6) AS b, round(avg(greatest(f1, o)), 6) AS oracle FROM x",
    "ag34_subject_priority": f"WITH {_ORDERPOOL} SELECT entity, frame, round(center, 6) AS center, CASE cls WHEN 'R' THEN 'person' ELSE 'pet' END AS kind FROM op WHERE cls = 'R' OR entity NOT IN (SELECT entity FROM op WHERE cls = 'R')",
    "ag35_argmax_series": f"WITH {DETS}, b AS (SELECT l_orderkey AS entity, frame, c, round(conf * sqrt(area), 9) AS sc, cls FROM dets WHERE cls = 'R' QUALIFY row_number() OVER (PARTITION BY l_orderkey, frame ORDER BY round(conf * sqrt(area), 9) DESC, c, l_extendedprice) = 1) SELECT o_orderkey AS entity, g.frame::INT AS frame, round(coalesce(c, 0.5), 6) AS c, round(coalesce(sc, 0), 6) AS score, coalesce(cls, '-') AS cls FROM orders CROSS JOIN range(1, 8) g(frame) LEFT JOIN b ON b.entity = o_orderkey AND b.frame = g.frame",
    "ag37_person_frames": f"WITH {DETS} SELECT entity, frame, round(greatest(0, least(1, sum(conf * area * c) / sum(conf * area))), 6) AS center, count(*) AS n FROM dets WHERE cls = 'R' AND conf >= 0.2 GROUP BY ALL HAVING sum(conf * area) > 0",
    "ag38_median_or_half": f"WITH {_ORDERPOOL} SELECT o_orderkey AS entity, round(coalesce(m, 0.5), 6) AS center FROM orders LEFT JOIN (SELECT entity, quantile_cont(center, 0.5) AS m FROM op WHERE cls = 'R' GROUP BY 1) ON entity = o_orderkey",
}


def _sparse(s, d):
    """Few detections a frame: one order in 37."""
    return pool.entity_centers(pool.pool_frames(src.detections(s, d).where("l_orderkey % 37 = 0")))


def _kinds(s, d):
    return src.table(s, d, "supplier").select(F.col("s_suppkey").alias("entity"), F.when(F.col("s_acctbal") > 7000, "pet").otherwise("person").alias("kind"))


def _gains(s, d):
    """Per order a gain and how cluttered it is."""
    li = src.table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("entity")).agg((F.avg(F.col("l_partkey") % 1000) / 1000).alias("g"), (F.avg("l_quantity") / 50).alias("stat"))
    return li.select("entity", "stat", (F.col("g") - 0.5).alias("delta"))


QUERIES |= {
    "jn11_spatial_frames": lambda s, d: rounded(match.containing(src.detections(s, d).select("entity", "frame", "c", "l_orderkey", "l_extendedprice"), _truth(s, d).select("entity", "frame", "lo", "hi"), F.col("c"), ("entity", "frame")).groupBy("entity", "frame").agg(F.count(F.lit(1)).alias("n"))),
    "ag13_sampled_presence": lambda s, d: rounded(tracks.track_stats(_entries(s, d), src.table(s, d, "supplier").select(F.col("s_suppkey").alias("entity"), (F.col("s_suppkey") % 3 * 100).alias("n_sampled"))).select("entity", "track", "n", "presence")),
    "fl19_single_subject": lambda s, d: rounded(gates.compound(_kinds(s, d), _sparse(s, d), 2.5, 0.3, "pet")),
    "fl20_sign_gate": lambda s, d: rounded(gates.sign_consistent(_sparse(s, d), pool.entity_centers(pool.pool_frames(src.detections(s, d).where("cls = 'R'"))))),
    "or3_three_samples": lambda s, d: report.samples(src.detections(s, d), ["entity", "cls"], ["l_orderkey", "l_extendedprice", "c"], 3).select("entity", "cls", "l_orderkey"),
    "or10_track_centers": lambda s, d: _entries(s, d).groupBy("entity", "track").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("frame", "pos", "c"))), lambda x: F.concat_ws(":", x["frame"].cast("string"), F.rint(x["c"] * 1000).cast("int").cast("string"))), ",").alias("series")),
    "pr25_truth_maps": lambda s, d: src.boxes(s, d, "O").groupBy("entity").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("frame", F.array(*(F.col(c).cast("int") for c in ("x", "y", "w")))))))).alias("boxes")),
    "xp9_held_out_cuts": lambda s, d: rounded(trials.held_out_cuts(_gains(s, d), "stat", "delta", [0.0, 0.1, 0.3], 10)),
}

_SPARSE = f"{DETS}, pooled AS (SELECT entity, frame, greatest(0.0, least(1.0, sum(conf * area * c) / sum(conf * area))) AS center, count(*) AS n FROM dets WHERE l_orderkey % 37 = 0 GROUP BY ALL HAVING sum(conf * area) > 0), cs AS (SELECT entity, quantile_cont(center, 0.5) AS median, avg(n) AS clutter, avg((n = 1)::INT) AS single FROM pooled GROUP BY entity)"
ORACLE_SQL |= {
    "jn11_spatial_frames": f"WITH {_COVER} SELECT dets.entity, dets.frame, count(*) AS n FROM dets JOIN tr ON tr.entity = dets.entity AND tr.frame = dets.frame AND c BETWEEN lo AND hi GROUP BY ALL",
    "ag13_sampled_presence": "SELECT l_suppkey AS entity, l_linenumber AS track, count(*) AS n, round(count(*) / greatest(1, l_suppkey % 3 * 100), 6) AS presence FROM lineitem GROUP BY l_suppkey, l_linenumber",
    "fl19_single_subject": f"WITH {_SPARSE}, k AS (SELECT s_suppkey AS entity, CASE WHEN s_acctbal > 7000 THEN 'pet' ELSE 'person' END AS kind FROM supplier), g AS (SELECT entity, kind, median, coalesce(single, 0) AS single, median IS NULL OR (kind <> 'pet' AND clutter > 2.5) AS gated FROM k LEFT JOIN cs USING (entity)) SELECT entity, kind, gated, NOT gated AND (kind = 'pet' OR single >= 0.3) AS traced, round(CASE WHEN gated THEN 0.5 ELSE median END, 6) AS center FROM g",
    "fl20_sign_gate": f"WITH {_SPARSE}, pr AS (SELECT entity, frame, greatest(0.0, least(1.0, sum(conf * area * c) / sum(conf * area))) AS center FROM dets WHERE cls = 'R' GROUP BY ALL HAVING sum(conf * area) > 0), o AS (SELECT entity, quantile_cont(center, 0.5) AS other FROM pr GROUP BY entity), r AS (SELECT entity, median, coalesce(sign(round(median, 9) - 0.5) = sign(round(other, 9) - 0.5), false) AS same FROM cs LEFT JOIN o USING (entity)) SELECT entity, round(CASE WHEN same THEN median ELSE 0.5 END, 6) AS center, NOT same AS gated FROM r",
    "or3_three_samples": f"WITH {DETS} SELECT entity, cls, l_orderkey FROM dets QUALIFY row_number() OVER (PARTITION BY entity, cls ORDER BY l_orderkey, l_extendedprice, c) <= 3",
    "or10_track_centers": "SELECT l_suppkey AS entity, l_linenumber AS track, string_agg(l_orderkey || ':' || (l_partkey % 1000), ',' ORDER BY l_orderkey, l_partkey, l_extendedprice) AS series FROM lineitem GROUP BY ALL",
    "pr25_truth_maps": "WITH t AS (SELECT l_orderkey AS entity, l_linenumber AS frame, min(l_partkey % 200) AS x FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL) SELECT entity, '{' || string_agg('\"' || frame || '\":[' || x || ',0,169]', ',' ORDER BY frame) || '}' AS boxes FROM t GROUP BY entity",
    "xp9_held_out_cuts": "WITH r AS (SELECT l_orderkey AS entity, avg(l_partkey % 1000) / 1000 - 0.5 AS delta, avg(l_quantity) / 50 AS stat FROM lineitem GROUP BY 1), h AS (SELECT *, ('0x' || substr(md5(split::VARCHAR || ':' || entity::VARCHAR), 1, 8))::BIGINT % 2 = 0 AS train FROM r, (SELECT unnest(range(10)) AS split)), c AS (SELECT split, q::DOUBLE AS q, quantile_cont(stat, 1 - 0.0) FILTER (q = 0.0) AS c0, quantile_cont(stat, 0.9) AS c1, quantile_cont(stat, 0.7) AS c3 FROM h, (SELECT unnest([0.0, 0.1, 0.3]) AS q) WHERE train GROUP BY split, q), k AS (SELECT split, q, CASE WHEN q = 0 THEN c0 WHEN q < 0.2 THEN c1 ELSE c3 END AS cut FROM c), e AS (SELECT q, split, avg(CASE WHEN stat <= cut THEN delta ELSE 0 END) AS gain, any_value(cut) AS cut FROM h JOIN k USING (split) WHERE NOT train GROUP BY q, split) SELECT q, count(*) AS n, round(avg(gain), 6) AS mean, round(stddev_samp(gain) / sqrt(count(*)), 6) AS se, round(avg(cut), 6) AS cut FROM e GROUP BY q",
}
