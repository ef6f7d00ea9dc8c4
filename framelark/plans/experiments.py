"""Queries of selections and experiments, with SQL. Suppliers and users play clips."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import experiments, pool, selection, windows
from ..sources import frames as src
from ._base import DETS, SIGNAL, rounded

SIGMAS = [0.0, 0.02, 0.0675, 0.2]
OVERLAP = 0.65
MODELS = {"const": [], "pool": ["mu"], "pool_distance": ["mu", "dm"], "pool_counts": ["mu", "nd", "sp"], "all": ["mu", "dm", "nd", "sp", "sd"]}
RULES = ["pres*area", "integrated"]


def _clips(s, d):
    """Suppliers as clips of 8 frames."""
    return src.table(s, d, "supplier").select(F.col("s_suppkey").alias("entity"), F.lit(8).alias("n"), (360 + F.col("s_suppkey") % 5 * 90).cast("double").alias("width"), F.lit(169.0).alias("crop"), F.lit(300.0).alias("h"))


def _truth(s, d):
    """A box of each supplier on the frames with open lines."""
    li = src.table(s, d, "lineitem").where("l_linestatus = 'O'")
    return li.groupBy(F.col("l_suppkey").alias("entity"), (F.col("l_linenumber") - 1).alias("frame")).agg(F.min(F.col("l_partkey") % 200).cast("double").alias("x")).select("entity", "frame", "x", F.lit(0.0).alias("y"), F.lit(169.0).alias("w"), F.lit(300.0).alias("h"))


def _clutter(s, d):
    return pool.entity_centers(pool.pool_frames(src.detections(s, d))).select("entity", "clutter")


def noise(s, d):
    return rounded(experiments.noise_curve(_truth(s, d), _clips(s, d), _clutter(s, d), SIGMAS, 5, 0.08, 85.0))


def inclusion(s, d):
    return rounded(experiments.marginal_inclusion(src.signal(s, d), F.col("event_type") == "purchase", OVERLAP))


def _features(s, d):
    """Per supplier: the true median centre, and how its detections lie."""
    dets = src.detections(s, d)
    frames = pool.pool_frames(dets).join(dets.groupBy("entity", "frame").agg(((F.max("c") - F.min("c")) / 2).alias("half")), ["entity", "frame"])
    seen = frames.groupBy("entity").agg(F.percentile("center", F.lit(0.5)).alias("mu"), F.stddev_pop("center").alias("sd"), F.log1p(F.avg("n")).alias("nd"), F.avg(F.when(F.col("n") > 1, F.col("half"))).alias("sp"))
    truth = _truth(s, d).join(_clips(s, d), "entity").groupBy("entity").agg(F.percentile((F.col("x") + F.col("w") / 2) / F.col("width"), F.lit(0.5)).alias("gt"))
    return seen.join(truth, "entity").withColumn("dm", F.abs(F.col("mu") - 0.5)).withColumn("sp", F.coalesce("sp", F.lit(0.0)))


def left_out(s, d):
    return rounded(experiments.linear_fit(_features(s, d), "gt", MODELS["all"]).select("entity", "fitted", "left_out"))


def fits(s, d):
    f = _features(s, d)
    return rounded(experiments.fit_report({m: experiments.linear_fit(f, "gt", x) for m, x in MODELS.items()}, "gt", "mu", _clips(s, d), _truth(s, d)))


def _series(s, d):
    e = src.signal(s, d)
    return e.select("entity", "frame", (F.col("frame") % 5).cast("double").alias("audio"), F.floor("value").cast("double").alias("motion"), (F.col("frame") * 7 % 11).cast("double").alias("person"))


def _base(s, d):
    """A box on every frame but the last 8 %."""
    e = windows.drop_tail(src.signal(s, d), 0.08)
    return e.select("entity", "frame", F.floor(F.col("value") * 2).cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(169.0).alias("w"), F.lit(300.0).alias("h"))


def _bought(s, d):
    e = src.signal(s, d).where("event_type = 'purchase'")
    return e.select("entity", "frame", (F.floor(F.col("value") * 2) + F.col("frame") % 40).cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(169.0).alias("w"), F.lit(300.0).alias("h"))


def _intervals(s, d):
    """From the first purchase to the last; users with odd numbers have none."""
    return src.signal(s, d).where("event_type = 'purchase' AND entity % 2 = 0").groupBy("entity").agg(F.min("frame").alias("start"), F.max("frame").alias("end"))


def kept(s, d):
    return selection.selected(_series(s, d), _base(s, d), _intervals(s, d))


def ranking(s, d):
    return rounded(selection.ranked(_series(s, d), _base(s, d), _bought(s, d), _intervals(s, d)))


def greedy(s, d):
    """Three windows a user, each sample standing for three frames."""
    e = src.signal(s, d).select("entity", "frame", F.round("value", 6).alias("score"))
    return selection.greedy_windows(e, "score", 0.2, 3, e.groupBy("entity").agg((F.count(F.lit(1)) * 3 + 1).alias("n")))


def _entries(s, d):
    """Lines as entries of three tracks a supplier; of a track's entries in a frame the first by order counts."""
    li = src.table(s, d, "lineitem").select(F.col("l_suppkey").alias("entity"), (F.col("l_linenumber") % 3).alias("track"), (F.col("l_orderkey") % 8).cast("int").alias("frame"), (F.col("l_partkey") % 1000 / 1000.0).alias("c"), (F.col("l_quantity") / 50).alias("area"), (1 - F.col("l_discount") * 5).alias("conf"), F.col("l_returnflag").alias("cls"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("pos"))
    return li.groupBy("entity", "track", "frame").agg(F.min_by(F.struct("c", "area", "conf", "cls", "pos"), "pos").alias("r")).select("entity", "track", "frame", "r.*")


def arms(s, d):
    return rounded(experiments.track_arms(_entries(s, d), _clips(s, d), _truth(s, d), RULES))


_RANKING = """
        WITH RECURSIVE {select},
        pb AS (SELECT name, entity, frame, floor(value * 2) AS x FROM sel JOIN s USING (entity, frame)), tb AS (SELECT entity, frame, floor(value * 2) + frame % 40 AS x FROM s WHERE event_type = 'purchase'),
        nt AS (SELECT entity, count(*) AS n FROM tb GROUP BY entity), np AS (SELECT name, entity, count(*) AS n FROM pb GROUP BY ALL),
        si AS (SELECT name, p.entity, sum({iou}) AS s FROM pb p JOIN tb t ON t.entity = p.entity AND t.frame = p.frame GROUP BY ALL),
        f AS (SELECT name, avg(2 * coalesce(s, 0) / (coalesce(np.n, 0) + nt.n)) AS f1 FROM nt JOIN params ON true LEFT JOIN np USING (name, entity) LEFT JOIN si USING (name, entity) GROUP BY name),
        ranking AS (SELECT name, round(f1, 6) AS F1, round(count(*) / (SELECT count(*) FROM rows WHERE name = 'keep_all'), 6) AS keep_ratio, count(*) AS n_pred FROM pb JOIN f USING (name) GROUP BY name, f1)
"""
QUERIES = {
    "xp13_noise_curve": noise,
    "xp16_marginal_inclusion": inclusion,
    "xp11_left_out": left_out,
    "xp11_fit_report": fits,
    "uf3_selected_frames": kept,
    "ar9_experiment_ranking": ranking,
    "iv11_greedy_windows": greedy,
    "xp22_track_arms": arms,
    "xp14_nearest_ceiling": lambda s, d: rounded(experiments.nearest_ceiling(_truth(s, d), _clips(s, d))),
}

_CLIPS = "clips AS (SELECT s_suppkey AS entity, (360 + s_suppkey % 5 * 90)::DOUBLE AS width FROM supplier)"
_TRUTH = "truth AS (SELECT l_suppkey AS entity, l_linenumber - 1 AS frame, min(l_partkey % 200)::DOUBLE AS x FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL), nt AS (SELECT entity, count(*) AS n_truth FROM truth GROUP BY entity)"
_X = "round_even(greatest(0.0::DOUBLE, least({c} * width - 84.5, width - 169)), 0)"
_IOU = "greatest(0.0::DOUBLE, least({p}, t.x) + 169 - greatest({p}, t.x)) / (338 - greatest(0.0::DOUBLE, least({p}, t.x) + 169 - greatest({p}, t.x)))"
_DRAW = "(('0x' || substr(md5({}), 1, 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE"


def _f1(rows: str, by: str, kept: int = 7) -> str:
    """Mean F1 of constant or moving boxes ``rows`` (by, entity, frame, x) against the truth."""
    return f"""hit AS (SELECT {by}, p.entity, sum({_IOU.format(p='p.x')}) AS s FROM {rows} p JOIN truth t ON t.entity = p.entity AND t.frame = p.frame GROUP BY {by}, p.entity),
        made AS (SELECT {by}, entity, count(*) AS n_made FROM {rows} GROUP BY {by}, entity),
        f1s AS (SELECT {', '.join(f'made.{b.strip()}' for b in by.split(','))}, made.entity, 2 * coalesce(s, 0) / (n_made + n_truth) AS f1 FROM made JOIN nt USING (entity) LEFT JOIN hit ON hit.entity = made.entity AND {' AND '.join(f'hit.{b.strip()} = made.{b.strip()}' for b in by.split(','))})"""


_FEATURES = f"""{DETS}, {_CLIPS}, {_TRUTH},
    pooled AS (SELECT entity, frame, greatest(0.0, least(1.0, sum(conf * area * c) / sum(conf * area))) AS center, count(*) AS n FROM dets GROUP BY ALL HAVING sum(conf * area) > 0),
    spread AS (SELECT entity, frame, (max(c) - min(c)) / 2 AS half FROM dets GROUP BY ALL),
    seen AS (SELECT entity, quantile_cont(center, 0.5) AS mu, stddev_pop(center) AS sd, ln(1 + avg(n)) AS nd, coalesce(avg(half) FILTER (n > 1), 0) AS sp FROM pooled JOIN spread USING (entity, frame) GROUP BY entity),
    gts AS (SELECT entity, quantile_cont((x + 84.5) / width, 0.5) AS gt FROM truth JOIN clips USING (entity) GROUP BY entity),
    feats AS (SELECT seen.*, gt, abs(mu - 0.5) AS dm FROM seen JOIN gts USING (entity))"""


def _fit(names: list[str], out: str) -> str:
    """Least squares by making the features orthogonal one after another: fitted and left_out in ``out``."""
    x = lambda step, j: f"x{step}_{j}"
    # a feature that the ones before it explain has nothing left
    part = lambda y, v: f"CASE WHEN sum({v} * {v}) OVER () > 1e-12 THEN sum({y} * {v}) OVER () / sum({v} * {v}) OVER () * {v} ELSE 0 END"
    k = len(names)
    steps = [f"{out}0 AS (SELECT entity, mu, gt{''.join(f', {f} - avg({f}) OVER () AS {x(0, i)}' for i, f in enumerate(names))} FROM feats)"]
    for i in range(k - 1):
        rest = [f"{x(i, j)} - {part(x(i, j), x(i, i))} AS {x(i + 1, j)}" for j in range(i + 1, k)]
        steps.append(f"{out}{i + 1} AS (SELECT *, {', '.join(rest)} FROM {out}{i})")
    own = [x(i, i) for i in range(k)]
    fitted = " + ".join(["avg(gt) OVER ()"] + [part("gt", v) for v in own])
    leverage = " + ".join(["1.0::DOUBLE / count(*) OVER ()"] + [f"CASE WHEN sum({v} * {v}) OVER () > 1e-12 THEN {v} * {v} / sum({v} * {v}) OVER () ELSE 0 END" for v in own])
    steps.append(f"{out}f AS (SELECT entity, mu, gt, {fitted} AS fitted, {leverage} AS lev FROM {out}{max(0, k - 1)})")
    steps.append(f"{out} AS (SELECT entity, mu, gt, fitted, gt - (gt - fitted) / (1 - lev) AS left_out FROM {out}f)")
    return ", ".join(steps)


_Z = "CASE WHEN stddev_pop({0}) OVER e > 1e-9 THEN ({0} - avg({0}) OVER e) / stddev_pop({0}) OVER e ELSE 0 END"
_MM = "CASE WHEN max({0}) OVER e > min({0}) OVER e THEN ({0} - min({0}) OVER e) / (max({0}) OVER e - min({0}) OVER e) ELSE 0 END"
_PARAMS = ", ".join(f"('{e.name}', '{e.selector}', {e.share}::DOUBLE, {e.lo}::DOUBLE, {e.hi}::DOUBLE, {e.k}, {e.widen}::DOUBLE, {e.weights.get('audio', 0.0)}::DOUBLE, {e.weights.get('motion', 0.0)}::DOUBLE, {e.weights.get('person', 0.0)}::DOUBLE)" for e in selection.EXPERIMENTS)
#: The frames that runs above a threshold keep, in lists: places above it, ends of runs, the k longest runs (ties: the latest), all their places.
_BISECT = """
    b AS (SELECT name, entity, k, g, sc, greatest(1, round_even(share * len(g), 0)) AS target, list_min(sc) AS lo, list_max(sc) AS hi, 0 AS step, NULL::BIGINT[] AS best FROM lists
          UNION ALL SELECT name, entity, k, g, sc, target, CASE WHEN len(kept) > target THEN th ELSE lo END, CASE WHEN len(kept) > target THEN hi ELSE th END, step + 1,
                CASE WHEN best IS NULL OR abs(len(kept) - target) < abs(len(best) - target) THEN kept ELSE best END
          FROM (SELECT *, list_distinct(flatten(list_transform(list_slice(list_reverse_sort(runs), 1, k), lambda r: list_filter(g, lambda f: f >= r[2] AND f <= r[3])))) AS kept
                FROM (SELECT *, list_transform(range(1, len(firsts) + 1), lambda i: [ends[i] - firsts[i] + 1, firsts[i], ends[i]]) AS runs
                      FROM (SELECT *, list_filter(above, lambda f, i: i = 1 OR f - above[i - 1] > {gap}) AS firsts, list_filter(above, lambda f, i: i = len(above) OR above[i + 1] - f > {gap}) AS ends
                            FROM (SELECT *, list_filter(g, lambda f, i: sc[i] >= th) AS above FROM (SELECT *, (lo + hi) / 2 AS th FROM b WHERE step < 40)))))),
    runs_kept AS (SELECT name, entity, unnest(best) AS frame FROM b WHERE step = 40)"""
_SELECT = f"""
    params(name, selector, share, lo, hi, k, widen, wa, wm, wp) AS (VALUES {_PARAMS}), {SIGNAL},
    sig AS (SELECT entity, frame, (frame % 5)::DOUBLE AS a, floor(value) AS m, (frame * 7 % 11)::DOUBLE AS p, event_type, value, count(*) OVER (PARTITION BY entity) AS nf FROM s),
    mm AS (SELECT entity, frame, nf, {_MM.format("a")} AS a, {_MM.format("m")} AS m, {_MM.format("p")} AS p FROM sig WINDOW e AS (PARTITION BY entity)),
    z AS (SELECT entity, frame, nf, {_Z.format("a")} AS a, {_Z.format("m")} AS m, {_Z.format("p")} AS p FROM mm WINDOW e AS (PARTITION BY entity)),
    rows AS (SELECT name, entity, frame, nf, round(wa * a + wm * m + wp * p, 9) AS score, selector, share, lo, hi, k, widen, count(*) OVER (PARTITION BY name, entity) AS n FROM z, params WHERE frame < round_even((1 - 0.08::DOUBLE) * nf, 0)),
    lens AS (SELECT *, greatest(1, round_even(share * n, 0))::INT AS len FROM rows),
    lists AS (SELECT name, entity, any_value(share) AS share, any_value(k) AS k, list(frame ORDER BY frame) AS g, list(score ORDER BY frame) AS sc FROM rows WHERE selector = 'threshold_windows' GROUP BY name, entity),
    {_BISECT.format(gap=selection.MERGE_GAP)},
    sums AS (SELECT name, entity, frame, len, sum(score) OVER (PARTITION BY name, entity ORDER BY frame) AS t, score FROM lens WHERE selector = 'best_window'),
    wins AS (SELECT x.name, x.entity, x.frame, x.len FROM sums x JOIN sums y ON y.name = x.name AND y.entity = x.entity AND y.frame = x.frame + x.len - 1 QUALIFY row_number() OVER (PARTITION BY x.name, x.entity ORDER BY round(y.t - x.t + x.score, 6) DESC, x.frame) = 1),
    iv AS (SELECT entity, min(frame) AS f0, max(frame) AS f1 FROM s WHERE event_type = 'purchase' AND entity % 2 = 0 GROUP BY entity),
    chosen AS (SELECT name, entity, frame FROM rows WHERE selector = 'keep_all' OR (selector = 'position_window' AND frame >= lo * nf AND frame < hi * nf)
        UNION ALL SELECT name, entity, frame FROM (SELECT *, row_number() OVER (PARTITION BY name, entity ORDER BY score DESC, frame) AS r FROM lens WHERE selector = 'top_fraction') WHERE r <= len
        UNION ALL SELECT l.name, l.entity, l.frame FROM lens l JOIN wins w ON w.name = l.name AND w.entity = l.entity AND l.frame BETWEEN w.frame AND w.frame + w.len - 1
        UNION ALL SELECT name, entity, frame FROM runs_kept
        UNION ALL SELECT name, r.entity, frame FROM rows r LEFT JOIN iv USING (entity) WHERE selector = 'interval' AND (f1 IS NULL OR f1 <= f0 OR (frame >= (f0 + f1) / 2 - (f1 - f0) / 2 * widen AND frame < (f0 + f1) / 2 + (f1 - f0) / 2 * widen))),
    sel AS (SELECT * FROM chosen UNION ALL SELECT name, entity, frame FROM rows WHERE (name, entity) NOT IN (SELECT (name, entity) FROM chosen))"""

ORACLE_SQL = {
    "xp13_noise_curve": f"""
        WITH {DETS}, {_CLIPS}, {_TRUTH}, cl AS (SELECT entity, avg(n) AS clutter FROM (SELECT entity, frame, count(*) AS n FROM dets GROUP BY ALL HAVING sum(conf * area) > 0) GROUP BY entity),
        probe AS (SELECT entity, width, f, k, sigma FROM clips JOIN nt USING (entity), (SELECT unnest([0, 5]) AS f), (SELECT unnest(range({len(SIGMAS)}))::INT AS k, unnest({SIGMAS})::DOUBLE AS sigma)),
        near AS (SELECT probe.*, (t.x + 84.5) / width AS y FROM probe JOIN truth t USING (entity) QUALIFY row_number() OVER (PARTITION BY entity, f, k ORDER BY abs(t.frame - f), t.frame) = 1),
        est AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, y + sigma * sqrt(-2 * ln({_DRAW.format("k || ':' || entity || ':' || f || ':1'")})) * cos(2 * pi() * {_DRAW.format("k || ':' || entity || ':' || f || ':2'")}))) AS e FROM near),
        two AS (SELECT k, sigma, entity, width, quantile_cont(e, 0.5) AS m, max(e) FILTER (f = 0) AS e0, max(e) FILTER (f = 5) AS e5 FROM est GROUP BY ALL),
        fr AS (SELECT two.*, fr.frame, coalesce(clutter, 0) AS clutter, CASE WHEN fr.frame >= 5 THEN e5 ELSE e0 + (e5 - e0) * fr.frame / 5 END AS line FROM two LEFT JOIN cl USING (entity), range(7) fr(frame)),
        boxes AS (SELECT k, 'const' AS arm, entity, frame, {_X.format(c='m')} AS x FROM fr UNION ALL SELECT k, 'traj', entity, frame, {_X.format(c='line')} FROM fr UNION ALL SELECT k, 'gated', entity, frame, {_X.format(c='CASE WHEN clutter > 85 THEN 0.5 ELSE m END')} FROM fr),
        {_f1("boxes", "k, arm")}
        SELECT ({SIGMAS})[k + 1]::DOUBLE AS sigma, round(avg(f1) FILTER (arm = 'const'), 6) AS const, round(avg(f1) FILTER (arm = 'traj'), 6) AS traj, round(avg(f1) FILTER (arm = 'gated'), 6) AS gated FROM f1s GROUP BY k
    """,
    "xp16_marginal_inclusion": f"""
        WITH RECURSIVE {SIGNAL}, n AS (SELECT *, count(*) OVER (PARTITION BY entity) AS n FROM s), hist AS (SELECT floor(50 * frame / n) AS bin, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS h, avg((event_type = 'purchase')::INT) AS rate FROM n GROUP BY 1),
        r AS (SELECT 0 AS round, NULL::DOUBLE AS threshold, count(*) AS n_bins, sum(n)::BIGINT AS n_kept, 2 * {OVERLAP}::DOUBLE * sum(h) / (sum(n) + sum(h)) AS f1 FROM hist
              UNION ALL SELECT round + 1, f1 / {2 * OVERLAP}, (SELECT count(*) FROM hist WHERE rate > f1 / {2 * OVERLAP}), (SELECT sum(n)::BIGINT FROM hist WHERE rate > f1 / {2 * OVERLAP}),
                    2 * {OVERLAP}::DOUBLE * (SELECT sum(h) FROM hist WHERE rate > f1 / {2 * OVERLAP}) / ((SELECT sum(n) FROM hist WHERE rate > f1 / {2 * OVERLAP}) + (SELECT sum(h) FROM hist))
              FROM r WHERE round < 20 AND (SELECT count(*) FROM hist WHERE rate > f1 / {2 * OVERLAP}) <> n_bins)
        SELECT round::INT AS round, round(threshold, 6) AS threshold, n_bins::INT AS n_bins, n_kept, round(f1, 6) AS f1, (SELECT count(*) FROM hist WHERE rate > f1 / {2 * OVERLAP}) = n_bins AS settled FROM r
    """,
    "xp11_left_out": f"WITH {_FEATURES}, {_fit(MODELS['all'], 'm')} SELECT entity, round(fitted, 6) AS fitted, round(left_out, 6) AS left_out FROM m",
    "xp11_fit_report": f"""
        WITH {_FEATURES}, {', '.join(_fit(x, 'fit_' + m) for m, x in MODELS.items())},
        everything AS ({' UNION ALL '.join(f"SELECT '{m}' AS model, * FROM fit_{m}" for m in MODELS)}),
        boxes AS (SELECT model, entity, fr.frame, {_X.format(c='greatest(0.0::DOUBLE, least(1.0::DOUBLE, left_out))')} AS x FROM everything JOIN clips USING (entity), range(7) fr(frame)),
        {_f1("boxes", "model")}, means AS (SELECT model, avg(f1) AS f1 FROM f1s GROUP BY model),
        q AS (SELECT model, count(*) AS n, 1 - avg((gt - left_out) ** 2) / var_pop(gt) AS r2, sqrt(avg((gt - left_out) ** 2)) AS rmse, 1 - avg(abs(gt - left_out)) / avg(abs(mu - gt)) AS credit FROM everything GROUP BY model)
        SELECT model, n, round(r2, 6) AS r2, round(rmse, 6) AS rmse, round(f1, 6) AS f1, round(credit, 6) AS credit FROM q JOIN means USING (model)
    """,
    "uf3_selected_frames": f"WITH RECURSIVE {_SELECT} SELECT name, entity, frame FROM sel",
    "ar9_experiment_ranking": _RANKING.format(select=_SELECT, iou=_IOU.format(p="p.x")) + " SELECT name, F1, keep_ratio, n_pred FROM ranking",
    "sk4_ranking_file": _RANKING.format(select=_SELECT, iou=_IOU.format(p="p.x")) + " SELECT name, F1, keep_ratio, n_pred, row_number() OVER (ORDER BY F1 DESC, name) AS place FROM ranking",
    "iv4_threshold_windows": f"""
        WITH RECURSIVE {SIGNAL}, lists AS (SELECT 'all' AS name, entity, 0.3::DOUBLE AS share, 2 AS k, list(frame ORDER BY frame) AS g, list(round(value, 6) ORDER BY frame) AS sc FROM s GROUP BY entity), {_BISECT.format(gap=3)}
        SELECT entity, frame FROM runs_kept
    """,
    "iv11_greedy_windows": f"""
        WITH RECURSIVE {SIGNAL}, n AS (SELECT entity, frame, round(value, 6) AS score, count(*) OVER (PARTITION BY entity) AS m FROM s),
        l AS (SELECT *, 3 * m + 1 AS n, greatest(1, round_even(0.2::DOUBLE * (3 * m + 1), 0)) AS budget FROM n),
        k AS (SELECT *, least(m, greatest(1, round_even(budget * m / n, 0)))::INT AS len FROM l),
        w AS (SELECT a.entity, a.frame AS i, a.len, a.m, a.n, round(sum(b.score) / any_value(a.len), 9) AS mean, count(*) AS c FROM k a JOIN k b ON a.entity = b.entity AND b.frame BETWEEN a.frame AND a.frame + a.len - 1 GROUP BY ALL),
        c AS (SELECT entity, any_value(len) AS len, any_value(m) AS m, any_value(n) AS n, list({{'i': i, 'mean': mean}} ORDER BY mean DESC, i) AS ws FROM w WHERE c = len GROUP BY entity),
        g AS (SELECT entity, len, m, n, ws, 1 AS step, [ws[1].i] AS picks, ws[1].mean AS top, NULL::DOUBLE AS second FROM c
              UNION ALL SELECT entity, len, m, n, ws, step + 1, CASE WHEN nx IS NULL THEN picks ELSE list_append(picks, nx.i) END, top, CASE WHEN step = 1 THEN nx.mean ELSE second END
              FROM (SELECT *, list_filter(ws, lambda x: len(list_filter(picks, lambda q: abs(q - x.i) < len)) = 0)[1] AS nx FROM g WHERE step < 3)),
        e AS (SELECT entity, len, m, n, CASE WHEN second < 0.8 * top THEN [picks[1]] ELSE picks END AS p FROM g WHERE step = 3),
        h AS (SELECT *, greatest(0, least(n - 1, round_even(list_min(p) * n / m, 0)))::INT AS a, round_even((list_max(p) + len) * n / m, 0)::INT AS b FROM e)
        SELECT entity, a AS start, greatest(a + 1, least(n, b))::INT AS "end", len(p)::INT AS windows FROM h
    """,
    "xp14_nearest_ceiling": f"""
        WITH {_CLIPS}, {_TRUTH}, boxes AS (SELECT 1 AS one, clips.entity, fr.frame, near.x FROM clips JOIN nt USING (entity), range(7) fr(frame), LATERAL (SELECT t.x FROM truth t WHERE t.entity = clips.entity ORDER BY abs(t.frame - fr.frame), t.frame LIMIT 1) near),
        {_f1("boxes", "one")}
        SELECT entity, round(f1, 6) AS f1 FROM f1s
    """,
    "xp22_track_arms": f"""
        WITH {_CLIPS}, {_TRUTH},
        raw AS (SELECT l_suppkey AS entity, l_linenumber % 3 AS track, (l_orderkey % 8)::INT AS frame, l_partkey % 1000 / 1000.0::DOUBLE AS c, l_quantity / 50 AS area FROM lineitem
                QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_linenumber % 3, l_orderkey % 8 ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) = 1),
        st AS (SELECT entity, track, count(*) / (SELECT count(DISTINCT frame) FROM raw r WHERE r.entity = raw.entity) * avg(area) AS "pres*area", sum(area) AS integrated FROM raw GROUP BY entity, track),
        mains AS ({' UNION ALL '.join(f"(SELECT '{r}' AS rule, entity, track FROM st QUALIFY row_number() OVER (PARTITION BY entity ORDER BY round(" + chr(34) + r + chr(34) + f", 9) DESC, track) = 1)" for r in RULES)}),
        path AS (SELECT rule, entity, frame, c FROM mains JOIN raw USING (entity, track)), med AS (SELECT rule, entity, quantile_cont(c, 0.5) AS m FROM path GROUP BY ALL),
        grid AS (SELECT rule, entity, width, fr.frame, m FROM clips CROSS JOIN (SELECT unnest({RULES}) AS rule) LEFT JOIN med USING (rule, entity), range(7) fr(frame)),
        lines AS (SELECT grid.*, (SELECT max(p.frame) FROM path p WHERE p.rule = grid.rule AND p.entity = grid.entity AND p.frame <= grid.frame) AS f0, (SELECT min(p.frame) FROM path p WHERE p.rule = grid.rule AND p.entity = grid.entity AND p.frame >= grid.frame) AS f1 FROM grid),
        ends AS (SELECT l.*, a.c AS c0, b.c AS c1 FROM lines l LEFT JOIN path a ON a.rule = l.rule AND a.entity = l.entity AND a.frame = l.f0 LEFT JOIN path b ON b.rule = l.rule AND b.entity = l.entity AND b.frame = l.f1),
        line AS (SELECT *, coalesce(CASE WHEN c0 IS NULL THEN c1 WHEN c1 IS NULL OR f1 = f0 THEN c0 ELSE c0 + (c1 - c0) * (frame - f0) / (f1 - f0) END, 0.5) AS moving FROM ends),
        boxes AS (SELECT 'control' AS arm, entity, fr.frame, {_X.format(c='0.5')} AS x FROM clips, range(7) fr(frame)
            {' '.join(f"UNION ALL SELECT rule || ' const {b:g}', entity, frame, {_X.format(c=f'({b}::DOUBLE * coalesce(m, 0.5) + (1 - {b}::DOUBLE) * 0.5)')} FROM line" for b in (0.37, 0.5, 1.0))}
            UNION ALL SELECT rule || ' frame', entity, frame, {_X.format(c='moving')} FROM line),
        {_f1("boxes", "arm")}
        SELECT arm, round(avg(f1), 6) AS f1 FROM f1s GROUP BY arm
    """,
}
