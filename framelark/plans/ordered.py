"""Queries over ordered series, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals, sequence, windows
from ..sources import frames as src
from ._base import SIGNAL, rounded


def _s(s, d):
    return src.signal(s, d)


def _score(s, d):
    return _s(s, d).select("entity", "frame", F.round("value", 6).alias("score"))


def _truth(s, d):
    return _s(s, d).where("event_type = 'purchase'").select("entity", "frame")


def _key(make):
    return lambda s, d: rounded(_s(s, d).select("entity", "frame", make().alias("v")))


def _signals(s, d):
    return _s(s, d).select("entity", "frame", F.col("value").alias("motion"), (F.col("frame") % 5).cast("double").alias("audio"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("person"))


NAMES = ["keep_all", "drop_tail", "position_window", "top_fraction", "best_window"]
QUERIES = {
    "wn1_even_average": _key(lambda: windows.average("value", 4)),
    "wn2_smooth": _key(lambda: windows.smooth("value", 6)),
    "wn3_median5": _key(lambda: windows.median("value", 5)),
    "wn5_robust": lambda s, d: rounded(sequence.robust(_s(s, d), "value").select("entity", "frame", "robust")),
    "wn6_minmax": _key(lambda: sequence.minmax(F.col("value"))),
    "wn7_zscore": _key(lambda: sequence.zscore(F.col("value"))),
    "wn8_combined_score": lambda s, d: rounded(windows.combined_score(_signals(s, d).drop("person"), {"motion": 1.0, "audio": 0.5, "person": 1.0}).select("entity", "frame", "score")),
    "wn8_weighted_mean": lambda s, d: rounded(_signals(s, d).select("entity", "frame", windows.weighted_mean_score({"motion": 1.0, "audio": 0.5, "person": 2.0}).alias("score"))),
    "wn9_sliding": lambda s, d: rounded(windows.sliding(_s(s, d), "value", 7)),
    "wn10_difference": _key(lambda: F.col("value") - F.lag("value").over(sequence.by_frame())),
    "wn11_densify": lambda s, d: rounded(sequence.interpolate(_truth(s, d).withColumn("y", F.col("frame").cast("double") ** 2), _s(s, d).groupBy("entity").agg(F.count(F.lit(1)).alias("n"))).select("entity", "frame", "linear")),
    "wn13_resample": lambda s, d: rounded(windows.resample(_s(s, d), "value", 9)),
    "wn15_average_ranks": lambda s, d: _s(s, d).withColumn("v", F.round(F.col("value") / 10)).select("entity", "frame", (F.rank().over(_by_value()) + (F.count(F.lit(1)).over(_peers()) - 1) / 2).alias("rank")),
    "wn17_position_rate": lambda s, d: rounded(windows.hit_rate_by_position(_s(s, d), F.col("event_type") == "purchase", 50)),
    "wn19_keyframes": lambda s, d: windows.keyframes(_s(s, d), 15).select("entity", "frame"),
    "wn20_centred_fallback": lambda s, d: rounded(windows.centred_fallback(_s(s, d).where("value > 99").select("entity", "frame", (F.col("value") / 100).alias("center")), _s(s, d).groupBy("entity").agg(F.count(F.lit(1)).alias("n")))),
    "iv2_threshold_runs": lambda s, d: intervals.islands(_s(s, d).where("value > 60").select("entity", "frame"), 2),
    "iv4_threshold_windows": lambda s, d: windows.threshold_windows(_score(s, d), "score", 0.3, 2, 3),
    "iv5_clamped_segments": lambda s, d: intervals.merge_segments(_s(s, d).select("entity", F.least(F.lit(40), F.least(F.col("frame"), F.floor(F.col("value")))).alias("start"), F.least(F.lit(40), F.greatest(F.col("frame"), F.floor(F.col("value")))).alias("end")).where("end - start < 6")),
    "iv9_hull": lambda s, d: windows.hull(_truth(s, d)),
    "iv11_best_segments": lambda s, d: windows.best_segments(_score(s, d), "score", 0.2),
    "iv13_position_window": lambda s, d: windows.position_window(_s(s, d), 0.16, 0.88).select("entity", "frame"),
    "iv13_drop_tail": lambda s, d: windows.drop_tail(_s(s, d), 0.08).select("entity", "frame"),
    "iv14_keep_all": lambda s, d: windows.select(_score(s, d), "keep_all"),
    "se4_distinct_places": lambda s, d: _s(s, d).groupBy("entity").agg(F.array_join(F.array_sort(F.array_distinct(F.collect_list(F.floor(F.col("value") / 20).cast("int")))).cast("array<string>"), ",").alias("places")),
    "se5_added_frames": lambda s, d: windows.added(windows.select(_score(s, d), "top_fraction"), _score(s, d)),
    "xp15_selector_matrix": lambda s, d: rounded(windows.selector_matrix(_score(s, d), _truth(s, d), NAMES)),
}


def _by_value():
    return sequence.whole().orderBy("v")


def _peers():
    from pyspark.sql import Window

    return Window.partitionBy("entity", "v")


def _padded(left: int, right: int, what: str) -> str:
    """An aggregate over the frames around each one, the ends repeated."""
    return f"""
        WITH {SIGNAL}, n AS (SELECT *, count(*) OVER (PARTITION BY entity) AS n FROM s),
        p AS (SELECT a.entity, a.frame, any_value(a.n) AS n, any_value(a.value) AS own, {what.format("b.value")} AS v FROM n a JOIN (SELECT unnest(range({-left}, {right + 1})) AS o) ON true JOIN n b ON b.entity = a.entity AND b.frame = greatest(0, least(a.n - 1, a.frame + o)) GROUP BY a.entity, a.frame)"""


_Z = "CASE WHEN stddev_pop({0}) OVER e > 1e-9 THEN ({0} - avg({0}) OVER e) / stddev_pop({0}) OVER e ELSE 0 END"
_MM = "CASE WHEN max({0}) OVER e > min({0}) OVER e THEN ({0} - min({0}) OVER e) / (max({0}) OVER e - min({0}) OVER e) ELSE 0 END"
_N = f"{SIGNAL}, n AS (SELECT *, round(value, 6) AS score, count(*) OVER (PARTITION BY entity) AS n FROM s)"
_TOP = "SELECT entity, frame FROM n QUALIFY row_number() OVER (PARTITION BY entity ORDER BY score DESC, frame) <= greatest(1, round_even(0.6::DOUBLE * n, 0))"
_BEST = """lb AS (SELECT *, greatest(1, round_even({share}::DOUBLE * n, 0))::INT AS len FROM n),
        wb AS (SELECT a.entity, a.frame, a.len, sum(b.score) AS total, count(*) AS k FROM lb a JOIN lb b ON a.entity = b.entity AND b.frame BETWEEN a.frame AND a.frame + a.len - 1 GROUP BY ALL)"""
ORACLE_SQL = {
    "wn1_even_average": _padded(2, 1, "avg({})") + " SELECT entity, frame, round(v, 6) AS v FROM p",
    "wn2_smooth": _padded(3, 3, "avg({})") + " SELECT entity, frame, round(CASE WHEN n < 3 THEN own ELSE v END, 6) AS v FROM p",
    "wn3_median5": _padded(2, 2, "median({})") + " SELECT entity, frame, round(v, 6) AS v FROM p",
    "wn5_robust": f"WITH {SIGNAL}, q AS (SELECT entity, quantile_cont(value, 0.1) AS lo, quantile_cont(value, 0.9) AS hi FROM s GROUP BY 1) SELECT entity, frame, round(CASE WHEN hi > lo THEN greatest(0, least(1, (value - lo) / (hi - lo))) ELSE 0 END, 6) AS robust FROM s JOIN q USING (entity)",
    "wn6_minmax": f"WITH {SIGNAL} SELECT entity, frame, round({_MM.format('value')}, 6) AS v FROM s WINDOW e AS (PARTITION BY entity)",
    "wn7_zscore": f"WITH {SIGNAL} SELECT entity, frame, round({_Z.format('value')}, 6) AS v FROM s WINDOW e AS (PARTITION BY entity)",
    "wn8_combined_score": f"WITH {SIGNAL}, m AS (SELECT entity, frame, {_MM.format('value')} AS a, {_MM.format('(frame % 5)')} AS b FROM s WINDOW e AS (PARTITION BY entity)) SELECT entity, frame, round({_Z.format('a')} + 0.5 * {_Z.format('b')}, 6) AS score FROM m WINDOW e AS (PARTITION BY entity)",
    "wn8_weighted_mean": f"WITH {SIGNAL} SELECT entity, frame, round(CASE WHEN event_type = 'purchase' THEN (value + 0.5 * (frame % 5) + 2 * value) / 3.5 ELSE (value + 0.5 * (frame % 5)) / 1.5 END, 6) AS score FROM s",
    "wn9_sliding": f"WITH {SIGNAL} SELECT entity, frame, round(t, 6) AS \"sum\", round(t / 7, 6) AS mean FROM (SELECT entity, frame, sum(value) OVER w AS t, count(*) OVER w AS k FROM s WINDOW w AS (PARTITION BY entity ORDER BY frame ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING)) WHERE k = 7",
    "wn10_difference": f"WITH {SIGNAL} SELECT entity, frame, round(value - lag(value) OVER (PARTITION BY entity ORDER BY frame), 6) AS v FROM s",
    "wn11_densify": f"""
        WITH {SIGNAL}, y AS (SELECT entity, frame, CASE WHEN event_type = 'purchase' THEN frame END AS pos FROM s),
        d AS (SELECT entity, frame, last_value(pos IGNORE NULLS) OVER b AS p, first_value(pos IGNORE NULLS) OVER a AS n FROM y
              WINDOW b AS (PARTITION BY entity ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY entity ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
        SELECT entity, frame, round(CASE WHEN p IS NULL THEN n * n WHEN n IS NULL OR n = p THEN p * p ELSE p * p + (n * n - p * p) * (frame - p) / (n - p) END::DOUBLE, 6) AS linear FROM d
    """,
    "wn13_resample": f"WITH {_N}, k AS (SELECT DISTINCT entity, n, p.p AS point, p.p * (n - 1) / 8 AS pos FROM n, range(9) p(p)) SELECT k.entity, point::INT AS point, round(a.value + coalesce((b.value - a.value) * (pos - floor(pos)), 0), 6) AS \"value\" FROM k JOIN n a ON a.entity = k.entity AND a.frame = floor(pos) LEFT JOIN n b ON b.entity = k.entity AND b.frame = floor(pos) + 1",
    "wn15_average_ranks": f"WITH {SIGNAL}, v AS (SELECT *, round(value / 10) AS v FROM s) SELECT entity, frame, rank() OVER (PARTITION BY entity ORDER BY v) + (count(*) OVER (PARTITION BY entity, v) - 1) / 2 AS rank FROM v",
    "wn17_position_rate": f"WITH {_N} SELECT floor(50 * frame / n)::INT AS bin, count(*) AS n, round(avg((event_type = 'purchase')::INT), 6) AS rate FROM n GROUP BY 1",
    "wn19_keyframes": f"WITH {_N} SELECT entity, frame FROM n WHERE frame % 15 = 0 OR frame = n - 1",
    "wn20_centred_fallback": f"WITH {_N} SELECT entity, frame, round(value / 100, 6) AS center FROM s WHERE value > 99 UNION ALL SELECT entity, frame, 0.5 FROM n WHERE (frame = 0 OR frame = n - 1) AND entity NOT IN (SELECT entity FROM s WHERE value > 99)",
    "iv2_threshold_runs": f"WITH {SIGNAL} SELECT entity, min(frame) AS start, max(frame) AS \"end\", count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY entity ORDER BY frame) AS run FROM (SELECT entity, frame, coalesce((frame - lag(frame) OVER (PARTITION BY entity ORDER BY frame) > 3)::INT, 1) AS new FROM s WHERE value > 60)) GROUP BY entity, run",
    "iv5_clamped_segments": f"""
        WITH {SIGNAL}, g AS (SELECT entity, least(40, frame, floor(value)::BIGINT) AS start, least(40, greatest(frame, floor(value)::BIGINT)) AS "end" FROM s),
        n AS (SELECT *, coalesce((start > max("end") OVER (PARTITION BY entity ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1)::INT, 1) AS new FROM g WHERE "end" - start < 6),
        i AS (SELECT *, sum(new) OVER (PARTITION BY entity ORDER BY start, "end") AS id FROM n)
        SELECT entity, min(start) AS start, max("end") AS "end" FROM i GROUP BY entity, id
    """,
    "iv9_hull": f"WITH {SIGNAL} SELECT entity, min(frame) AS start, max(frame) AS \"end\" FROM s WHERE event_type = 'purchase' GROUP BY entity",
    "iv11_best_segments": f"""
        WITH {_N}, {_BEST.format(share=0.2)}, m AS (SELECT entity, frame, len, round(total / len, 9) AS mean FROM wb WHERE k = len),
        f AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY entity ORDER BY mean DESC, frame) = 1),
        g AS (SELECT m.* FROM m JOIN f ON f.entity = m.entity AND abs(m.frame - f.frame) >= m.len QUALIFY row_number() OVER (PARTITION BY m.entity ORDER BY m.mean DESC, m.frame) = 1)
        SELECT f.entity, CASE WHEN g.mean >= 0.8 * f.mean THEN least(f.frame, g.frame) ELSE f.frame END AS start, CASE WHEN g.mean >= 0.8 * f.mean THEN greatest(f.frame, g.frame) ELSE f.frame END + f.len AS "end", CASE WHEN g.mean >= 0.8 * f.mean THEN 2 ELSE 1 END AS windows FROM f LEFT JOIN g ON g.entity = f.entity
    """,
    "iv13_position_window": f"WITH {_N} SELECT entity, frame FROM n WHERE frame >= 0.16::DOUBLE * n AND frame < 0.88::DOUBLE * n",
    "iv13_drop_tail": f"WITH {_N} SELECT entity, frame FROM n WHERE frame < round_even((1 - 0.08::DOUBLE) * n, 0)",
    "iv14_keep_all": f"WITH {SIGNAL} SELECT entity, frame FROM s",
    "se4_distinct_places": f"WITH {SIGNAL} SELECT entity, array_to_string(list_sort(list_distinct(list(floor(value / 20)::INT))), ',') AS places FROM s GROUP BY entity",
    "se5_added_frames": f"WITH {_N} SELECT entity, frame FROM ({_TOP}) WHERE (entity, frame) NOT IN (SELECT (entity, frame) FROM s)",
    "xp15_selector_matrix": f"""
        WITH {_N}, {_BEST.format(share=0.6)}, bw AS (SELECT * FROM wb WHERE k = len QUALIFY row_number() OVER (PARTITION BY entity ORDER BY round(total, 6) DESC, frame) = 1),
        sel AS (SELECT 'keep_all' AS name, entity, frame FROM n UNION ALL SELECT 'drop_tail', entity, frame FROM n WHERE frame < round_even((1 - 0.08::DOUBLE) * n, 0)
                UNION ALL SELECT 'position_window', entity, frame FROM n WHERE frame >= 0.16::DOUBLE * n AND frame < 0.88::DOUBLE * n UNION ALL SELECT 'top_fraction', * FROM ({_TOP})
                UNION ALL SELECT 'best_window', n.entity, n.frame FROM n JOIN bw ON bw.entity = n.entity AND n.frame BETWEEN bw.frame AND bw.frame + bw.len - 1),
        e AS (SELECT name, entity, count(*) AS k, count(*) FILTER (event_type = 'purchase') AS h FROM sel JOIN s USING (entity, frame) GROUP BY ALL),
        t AS (SELECT entity, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS t FROM s GROUP BY 1)
        SELECT name, sum(k)::BIGINT AS n_kept, round(sum(k) / sum(n), 6) AS keep_ratio, round(avg(2 * h / (k + t)), 6) AS dice FROM e JOIN t USING (entity) GROUP BY name
    """,
}
