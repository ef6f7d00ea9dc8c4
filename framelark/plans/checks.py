"""Queries of the validator and of gates, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gates, pool, validate
from ..sources import frames as src
from ._base import DETS, META, SIGNAL, rounded


def _submitted(s, d):
    """Orders with shipped lines as a submission: entity, tw, th (portrait if any line was returned), n."""
    li = src.table(s, d, "lineitem").where("l_linestatus = 'F'").groupBy(F.col("l_orderkey").alias("entity")).agg(F.max((F.col("l_returnflag") == "R").cast("int")).alias("r"), F.count(F.lit(1)).alias("n"))
    return li.select("entity", F.when(F.col("r") == 1, 9.0).otherwise(16.0).alias("tw"), F.when(F.col("r") == 1, 16.0).otherwise(9.0).alias("th"), "n")


def _index(s, d):
    return src.meta(s, d).join(src.table(s, d, "orders").where("o_orderpriority <> '1-URGENT'").select(F.col("o_orderkey").alias("entity")), "entity", "left_semi")


def _violations(s, d):
    return validate.against_index(_submitted(s, d), _index(s, d))


def _sizes(s, d):
    return src.table(s, d, "supplier").select(F.col("s_suppkey").alias("entity"), F.when(F.col("s_nationkey") != 3, F.col("s_acctbal") * 2).alias("size"))


def _lines(s, d):
    """Lines by shipping date: pos is total."""
    return src.table(s, d, "lineitem").select(F.col("l_orderkey").alias("entity"), F.col("l_linenumber").alias("frame"), F.struct("l_shipdate", "l_extendedprice", "l_partkey", "l_suppkey").alias("pos"))


def _entities(s, d):
    return src.table(s, d, "supplier").select(F.col("s_suppkey").alias("entity"), F.when(F.col("s_acctbal") > 7000, "pet").otherwise("person").alias("kind"))


def _centers(s, d):
    return pool.entity_centers(pool.pool_frames(src.detections(s, d)))


def _dark(s, d):
    """Events as brightness samples: mean 0..100, dark share 1 - value / 100."""
    return src.signal(s, d).select("entity", "frame", F.col("value").alias("mean"), (1 - F.col("value") / 100).alias("dark"), (F.col("event_type") == "purchase").alias("target"))


def _slates(s, d):
    samples = _dark(s, d)
    return gates.slates(samples.drop("target"), samples.where("target").select("entity", "frame"), 0.5, 60.0)


KEYWORDS = ["data", "market", "river"]
QUERIES = {
    "fl6_repeated_ids": lambda s, d: validate.repeated(_lines(s, d).withColumn("part", F.col("entity")), "part", ["pos"]).groupBy("entity").agg(F.count(F.lit(1)).alias("n")),
    "fl7_model_size": lambda s, d: validate.size_violations(_sizes(s, d)),
    "fl8_ratio_mismatch": lambda s, d: _violations(s, d).where("code = 'ratio'").select("entity"),
    "fl9_missing_unknown": lambda s, d: _violations(s, d).where("code <> 'ratio'"),
    "fl10_missing_metadata": lambda s, d: validate.without(_submitted(s, d), _index(s, d)),
    "fl11_unsorted": lambda s, d: validate.unsorted(_lines(s, d)),
    "fl12_report": lambda s, d: validate.report(_violations(s, d)).select("code", "n", F.array_join(F.col("sample").cast("array<string>"), ",").alias("sample")),
    "fl12_verdict": lambda s, d: validate.verdict(_violations(s, d)),
    "fl13_empty": lambda s, d: src.meta(s, d).select("entity").join(_submitted(s, d), "entity", "left").where("n IS NULL").select("entity"),
    "fl14_class_filter": lambda s, d: src.detections(s, d).where(gates.of_class(["R", "A"], 0.8)).groupBy("entity", "cls").agg(F.count(F.lit(1)).alias("n")),
    "fl15_keyword_gate": lambda s, d: src.table(s, d, "documents").where(gates.mentions(F.col("text"), KEYWORDS)).select("doc_id"),
    "fl19_compound_gate": lambda s, d: rounded(gates.compound(_entities(s, d), _centers(s, d), 85.0, 0.0, "pet")),
    "fl20_distance_gate": lambda s, d: rounded(gates.distance_grid(_centers(s, d), [0.0, 0.002, 0.01, 0.05])),
    "fl21_dark_slates": lambda s, d: _slates(s, d).where("slate").select("entity", "frame"),
    "fl22_truth_sanity": lambda s, d: validate.sane_truth(src.table(s, d, "orders").select(F.col("o_orderkey").alias("entity")).join(_lines(s, d), "entity", "left").select("entity", (F.col("frame") * 2 - 3).alias("frame"), F.lit(4).alias("n_frames"))),
    "fl23_min_evidence": lambda s, d: rounded(gates.with_evidence(src.table(s, d, "lineitem").select(F.col("l_orderkey").alias("entity"), (F.col("l_partkey") % 1000 / 1000.0).alias("c")), "c", 3)),
    "fl24_max_drop": lambda s, d: gates.capped_drop(_dark(s, d).withColumn("drop", F.col("mean") < 45), 0.5).select("entity", "frame", "drop"),
    "iv8_slate_drop": lambda s, d: gates.slate_drop(src.signal(s, d).select("entity", "frame"), _slates(s, d), 1, 0.5),
    "iv6_head_run": lambda s, d: gates.edge_runs(_slates(s, d), 1).select("entity", "head_end"),
    "iv7_tail_run": lambda s, d: gates.edge_runs(_slates(s, d), 1).select("entity", "tail_start"),
    "or9_quantile_cut": lambda s, d: rounded(gates.quantile_cut(_centers(s, d), "clutter", 0.3).select("entity", "clutter", "kept")),
}

_SUB = "sub AS (SELECT l_orderkey AS entity, max((l_returnflag = 'R')::INT) AS r FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1)"
_INDEX = f"{META}, idx AS (SELECT meta.* FROM meta JOIN orders ON o_orderkey = entity WHERE o_orderpriority <> '1-URGENT')"
_VIOL = f"{_SUB}, {_INDEX}, v AS (SELECT entity, CASE WHEN r IS NULL THEN 'missing' WHEN tw IS NULL THEN 'unknown' WHEN (r = 1) <> (tw = 9) THEN 'ratio' END AS code FROM sub FULL JOIN idx USING (entity))"
_CENTER = f"{DETS}, pooled AS (SELECT entity, frame, greatest(0.0, least(1.0, sum(conf * area * c) / sum(conf * area))) AS center, count(*) AS n FROM dets GROUP BY ALL HAVING sum(conf * area) > 0), cs AS (SELECT entity, quantile_cont(center, 0.5) AS median, avg(n) AS clutter, avg((n = 1)::INT) AS single FROM pooled GROUP BY entity)"
_SLATE = f"{SIGNAL}, sl AS (SELECT entity, frame, value <= 60 AND 1 - value / 100 >= 0.5 AND event_type <> 'purchase' AS slate FROM s)"
_EDGES = f"""{_SLATE},
    a AS (SELECT *, lag(frame) OVER (PARTITION BY entity ORDER BY frame) AS before, lead(frame) OVER (PARTITION BY entity ORDER BY frame) AS after FROM sl WHERE slate),
    r AS (SELECT *, max(CASE WHEN frame - coalesce(before, -1) > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY entity ORDER BY frame) AS cut_before,
          max(CASE WHEN coalesce(after, n) - frame > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY entity ORDER BY frame DESC) AS cut_after FROM a JOIN (SELECT entity, count(*) AS n FROM s GROUP BY entity) USING (entity)),
    e AS (SELECT entity, n, coalesce(max(frame) FILTER (cut_before = 0), -1) AS head_end, coalesce(min(frame) FILTER (cut_after = 0), n) AS tail_start FROM (SELECT entity, count(*) AS n FROM s GROUP BY entity) LEFT JOIN r USING (entity, n) GROUP BY entity, n)"""
ORACLE_SQL = {
    "fl6_repeated_ids": "SELECT l_orderkey AS entity, count(*) - 1 AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1",
    "fl7_model_size": """
        WITH z AS (SELECT CASE WHEN s_nationkey <> 3 THEN s_acctbal * 2 END AS size FROM supplier),
        t AS (SELECT count(*) AS n, count(size) AS given, count(*) FILTER (size > 0) AS good, count(DISTINCT size) FILTER (size > 0) AS kinds, max(size) AS top FROM z)
        SELECT * FROM (SELECT 'invalid' AS rule, given - good AS n FROM t UNION ALL SELECT 'partial', n - good FROM t WHERE good > 0 UNION ALL SELECT 'several', kinds FROM t WHERE kinds > 1 UNION ALL SELECT 'limit', 1 FROM t WHERE top > 9216) WHERE n > 0
    """,
    "fl8_ratio_mismatch": f"WITH {_VIOL} SELECT entity FROM v WHERE code = 'ratio'",
    "fl9_missing_unknown": f"WITH {_VIOL} SELECT entity, code FROM v WHERE code IN ('missing', 'unknown')",
    "fl10_missing_metadata": f"WITH {_SUB}, {_INDEX} SELECT entity FROM sub WHERE entity NOT IN (SELECT entity FROM idx)",
    "fl11_unsorted": "SELECT DISTINCT entity FROM (SELECT l_orderkey AS entity, l_linenumber < lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_extendedprice, l_partkey, l_suppkey) AS back FROM lineitem) WHERE back",
    "fl12_report": f"WITH {_VIOL} SELECT code, count(*) AS n, array_to_string(list_slice(list(entity ORDER BY entity), 1, 5), ',') AS sample FROM v WHERE code IS NOT NULL GROUP BY code",
    "fl12_verdict": f"WITH {_VIOL} SELECT count(*) AS n_violations, count(*) = 0 AS passed FROM v WHERE code IS NOT NULL",
    "fl13_empty": "SELECT o_orderkey AS entity FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')",
    "fl14_class_filter": f"WITH {DETS} SELECT entity, cls, count(*) AS n FROM dets WHERE cls IN ('R', 'A') AND conf >= 0.8 GROUP BY ALL",
    "fl15_keyword_gate": "SELECT doc_id FROM documents WHERE regexp_matches(lower(text), 'data|market|river')",
    "fl19_compound_gate": f"""
        WITH {_CENTER}, k AS (SELECT s_suppkey AS entity, CASE WHEN s_acctbal > 7000 THEN 'pet' ELSE 'person' END AS kind FROM supplier),
        g AS (SELECT entity, kind, median, coalesce(single, 0) AS single, median IS NULL OR (kind <> 'pet' AND clutter > 85) AS gated FROM k LEFT JOIN cs USING (entity))
        SELECT entity, kind, gated, NOT gated AND (kind = 'pet' OR single >= 0) AS traced, round(CASE WHEN gated THEN 0.5 ELSE median END, 6) AS center FROM g
    """,
    "fl20_distance_gate": f"WITH {_CENTER} SELECT d::DOUBLE AS least, count(*) AS n, count(*) FILTER (abs(median - 0.5) < d) AS n_gated, round(avg(CASE WHEN abs(median - 0.5) < d THEN 0.5 ELSE median END), 6) AS mean_center FROM cs, (SELECT unnest([0.0, 0.002, 0.01, 0.05])::DOUBLE AS d) GROUP BY d",
    "fl21_dark_slates": f"WITH {_SLATE} SELECT entity, frame FROM sl WHERE slate",
    "fl22_truth_sanity": "WITH r AS (SELECT o_orderkey AS entity, l_linenumber * 2 - 3 AS frame FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey), t AS (SELECT entity, count(frame) AS n, count(*) FILTER (frame BETWEEN 0 AND 3) AS n_kept FROM r GROUP BY 1) SELECT *, CASE WHEN n = 0 THEN 'no rows' WHEN n_kept = 0 THEN 'empty' END AS skip FROM t",
    "fl23_min_evidence": "SELECT l_orderkey AS entity, count(*) AS n, round(avg(l_partkey % 1000 / 1000.0::DOUBLE), 6) AS mean, round(stddev_pop(l_partkey % 1000 / 1000.0::DOUBLE), 6) AS sd FROM lineitem GROUP BY 1 HAVING count(*) >= 3 AND stddev_pop(l_partkey % 1000 / 1000.0::DOUBLE) > 1e-9",
    "fl24_max_drop": f"WITH {SIGNAL} SELECT entity, frame, value < 45 AND count(*) FILTER (value < 45) OVER (PARTITION BY entity) <= 0.5 * count(*) OVER (PARTITION BY entity) AS \"drop\" FROM s",
    "iv6_head_run": f"WITH {_EDGES} SELECT entity, head_end FROM e",
    "iv7_tail_run": f"WITH {_EDGES} SELECT entity, tail_start FROM e",
    "iv8_slate_drop": f"WITH {_EDGES}, d AS (SELECT entity, frame, frame <= head_end OR frame >= tail_start AS gone FROM s JOIN e USING (entity)) SELECT entity, frame FROM d QUALIFY NOT gone OR count(*) FILTER (gone) OVER (PARTITION BY entity) > 0.5 * count(*) OVER (PARTITION BY entity)",
    "or9_quantile_cut": f"WITH {_CENTER} SELECT entity, round(clutter, 6) AS clutter, clutter <= (SELECT quantile_cont(clutter, 0.7) FROM cs) AS kept FROM cs",
}
