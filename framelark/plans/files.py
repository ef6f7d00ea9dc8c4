"""Queries that write files from the driver tables and read them back, with SQL over the tables themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geometry import crop_size
from ..operators import labels, score
from ..sources import caches, folders, submissions
from ..sources import frames as src
from ._base import CROP, DETS, META, SIGNAL, rounded
from .experiments import ranking as _ranking

_C = F.col


def _entry():
    """A line of an order as the text of one prediction; every thirteenth part number breaks another rule."""
    bad = ["5", '{"bboxes":[1,2,3]}', '{"frame":NaN,"bboxes":[1,2,3]}', '{"frame":1.5,"bboxes":[1,2,3]}', '{"frame":true,"bboxes":[1,2,3]}', '{"frame":-1,"bboxes":[1,2,3]}', '{"frame":1,"bboxes":null}', '{"frame":2,"bboxes":[1,2]}', '{"frame":3,"bboxes":[-1,0,5]}', '{"frame":3,"bboxes":[0,0,0]}', '{"frame":3,"bboxes":[0,Infinity,5]}']
    text = F.concat(F.lit('{"frame":'), _C("l_linenumber").cast("string"), F.lit(',"bboxes":['), (_C("l_partkey") % 250).cast("string"), F.lit(", 0.5, 169]}"))
    for i, b in enumerate(bad):
        text = F.when(_C("l_partkey") % 40 == i, F.lit(b)).otherwise(text)
    return text


def _lines(s, d):
    """Orders as lines of a submission, in order; some are broken, some have blank lines before them."""
    at = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    li = src.table(s, d, "lineitem").select(_C("l_orderkey").alias("o_orderkey"), F.lit(0).alias("n"), *at)
    both = src.table(s, d, "orders").select("o_orderkey", F.lit(1).alias("n")).unionByName(li, allowMissingColumns=True)
    # ranges of orders over the tables themselves: lines are made once and in order
    both = both.repartitionByRange(folders.partitions_of(both), "o_orderkey")
    e = both.select("o_orderkey", "n", F.when(_C("n") == 0, F.struct(F.struct(*at).alias("at"), _entry().alias("entry"))).alias("e"))
    o = e.groupBy("o_orderkey").agg(F.sum("n").cast("int").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda x: x["entry"]), ",").alias("es"))
    o = o.select("o_orderkey", "es", F.explode(F.array_repeat(F.lit(1), _C("n")))).sortWithinPartitions("o_orderkey").withColumn("k", _C("o_orderkey") % 17)
    ratio = F.when(_C("o_orderkey") % 2 == 0, "[16, 9]").when(_C("k") == 6, '["9", 0]').otherwise("[9, 16.0]")
    rest = F.concat(F.lit(',"targetRatioWH":'), ratio, F.lit(',"predictions":'), F.when(_C("k") == 3, "7").otherwise(F.concat(F.lit("["), F.coalesce("es", F.lit("")), F.lit("]"))), F.lit("}"))
    named = lambda key: F.concat(F.lit('{"video_id":'), key, rest)
    key = _C("o_orderkey").cast("string")
    line = F.when(_C("k") == 0, F.concat(F.lit('{"video_id":'), key)).when(_C("k") == 1, F.concat(F.lit("["), key, F.lit("]"))).when(_C("k") == 2, F.concat(F.lit('{"video":'), key, rest)).when(_C("k") == 4, F.concat(F.lit('{"video_id":"x",'), F.substr(named(key), F.lit(2)))).when(_C("k") == 5, named((_C("o_orderkey") - 1).cast("string"))).when(_C("k") == 7, F.concat(F.lit(" \n\n"), named(F.concat(F.lit('"'), key, F.lit('"'))))).otherwise(named(key))
    return o.select(line.alias("value"))


def _submission(s, d):
    path = folders.shared_folder(s, "lines")
    _lines(s, d).write.text(path)
    return path


def _meta(s, d):
    return src.meta(s, d).select(_C("entity").cast("string").alias("video_id"), _C("w").cast("int").alias("W"), _C("h").cast("int").alias("H"), "n_frames")


def errors(s, d):
    return submissions.records(s, _submission(s, d))[1].select("video_id", "code", "reason")


def entries(s, d):
    good, _ = submissions.records(s, _submission(s, d))
    return submissions.checked(good, _meta(s, d)).select("video_id", "pos", "frame", "code", "soft")


def truth(s, d):
    return rounded(submissions.truth(s, _submission(s, d), _meta(s, d))[0])


def run(s, d):
    return submissions.run(s, _submission(s, d))[0]


def index(s, d):
    """Lists of a hundred or so videos a line."""
    path = folders.shared_folder(s, "index")
    m = src.meta(s, d).select(F.floor(_C("entity") / 100).alias("b"), F.struct(_C("entity").cast("string").alias("video_id"), F.when(_C("entity") % 5 != 0, F.array("tw", "th")).alias("targetRatioWH")).alias("r"))
    m.groupBy("b").agg(F.to_json(F.array_sort(F.collect_list("r"), lambda a, b: F.when(a["video_id"] < b["video_id"], -1).otherwise(1))).alias("value")).select("value").write.text(path)
    return submissions.index(s, path, whole=False).select("video_id", "tw", "th")


def _cached(s, d, rows, name):
    path = folders.shared_folder(s, name)
    caches.write_map(rows, path)
    return path


def _size():
    return [F.lit(360).alias("W"), F.lit(640).alias("H"), F.lit(8).alias("n_frames")]


def detection_facts(s, d):
    """Detections of suppliers as nested caches; sampled frames 0 to 7, the first without any."""
    per = src.detections(s, d).groupBy("entity", "frame").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_extendedprice", "c", F.struct("cls", "conf", _C("c").alias("cx"), _C("c").alias("cy"), "area").alias("d"))), lambda a, b: _order(a, b)), lambda x: x["d"]).alias("dets"))
    empty = F.array().cast("array<struct<cls: string, conf: double, cx: double, cy: double, area: double>>")
    frames = src.table(s, d, "supplier").select(_C("s_suppkey").alias("entity"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("frame")).join(per, ["entity", "frame"], "left").withColumn("dets", F.coalesce("dets", empty))
    nested = frames.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("frame", "dets")), lambda a, b: a["frame"] - b["frame"]).alias("fs"))
    rows = nested.select(_C("entity").alias("video_id"), F.struct(*_size(), F.transform("fs", lambda f: f["frame"]).alias("frames"), F.transform("fs", lambda f: f["dets"]).alias("dets")).alias("v"))
    return rounded(caches.detections(caches.sampled_detections(s, _cached(s, d, rows, "detections"))).select("video_id", "frame", "cls", "conf", "cx", "area"))


def _order(a, b):
    less = lambda k: F.when(a[k] < b[k], -1).when(a[k] > b[k], 1)
    return F.coalesce(less("l_orderkey"), less("l_extendedprice"), less("c"), F.lit(0))


def track_facts(s, d):
    """Lines as entries of their supplier's tracks, each a list of numbers and a class."""
    li = src.table(s, d, "lineitem")
    entry = F.concat(F.lit("["), F.concat_ws(", ", _C("l_orderkey").cast("string"), (_C("l_partkey") % 1000 / 1000.0).cast("string"), F.lit("0.5"), (_C("l_quantity") / 50).cast("string"), _C("l_discount").cast("string")), F.lit(', "'), _C("l_returnflag"), F.lit('"]'))
    per = li.groupBy(_C("l_suppkey").alias("e"), _C("l_linenumber").alias("t")).agg(F.array_join(F.array_sort(F.collect_list(entry)), ",").alias("es"))
    per = per.groupBy("e").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('"'), _C("t").cast("string"), F.lit('":['), "es", F.lit("]")))), ",").alias("ts"), F.array_join(F.array_sort(F.collect_list("t")).cast("array<string>"), ",").alias("sampled"))
    text = F.concat(F.lit('{"'), _C("e").cast("string"), F.lit('":{"W":360,"H":640,"n_frames":8,"sampled":['), "sampled", F.lit('],"tracks":{'), "ts", F.lit("}}}"))
    path = folders.shared_folder(s, "tracks")
    per.select(text.alias("value")).write.text(path)
    t = caches.tracks(s, path)
    return rounded(t.groupBy("video_id", "track").agg(F.count(F.lit(1)).alias("n"), F.sum("frame").alias("frames"), F.sum("cx").alias("cx"), F.sum("area").alias("area"), F.sum("conf").alias("conf"), F.max("cls").alias("cls"), F.max("n_sampled").cast("long").alias("n_sampled")))


def signal_facts(s, d):
    """Dense signals; one of them two frames short, one missing."""
    e = src.signal(s, d).groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("frame", "value"))).alias("vs"))
    v = F.transform("vs", lambda x: x["value"])
    rows = e.select(_C("entity").alias("video_id"), F.struct(F.lit(360).alias("W"), F.lit(640).alias("H"), F.size("vs").alias("n_frames"), F.lit(25.0).alias("fps"), v.alias("motion"), F.slice(v, F.lit(1), F.greatest(F.lit(0), F.size(v) - 2)).alias("audio")).alias("v"))
    return rounded(caches.signals(s, _cached(s, d, rows, "signals")).select("video_id", "frame", "motion", "audio", "person"))


def resumed(s, d):
    """Sums by user, made in two runs: the first one dies in its third batch."""
    todo = src.table(s, d, "events").select("user_id").distinct()
    events = src.table(s, d, "events")
    job = folders.Resumable(s, folders.shared_folder(s, "job"), "user_id")
    made: list[int] = []

    def work(rows):
        if len(made) == 2:
            made.append(-1)
            raise RuntimeError("killed")
        made.append(1)
        return events.join(rows, "user_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))

    try:
        job.run(todo, work, 4)
    except RuntimeError:
        pass
    return job.run(todo, work, 4)


def _clips(s, d):
    return src.meta(s, d).select(_C("entity").cast("string").alias("video_id"), "tw", "th")


def round_trip(s, d):
    """Boxes in the submission format and back."""
    path = folders.shared_folder(s, "submission")
    submissions.write(submissions.nest(src.boxes(s, d, "F").withColumnRenamed("entity", "video_id"), _clips(s, d), 12.5), path)
    good, _ = submissions.records(s, path)
    e = submissions.checked(good).where("code IS NULL").select("video_id", "frame", "x", "w")
    return good.select("video_id", "tw", "th", submissions.model_size().alias("size")).join(e, "video_id", "left")


def score_report(s, d):
    path = folders.shared_folder(s, "report")
    scores = score.score_entities(src.boxes(s, d, "F"), src.boxes(s, d, "O"))
    submissions.write_scores(rounded(scores), rounded(score.macro(scores)), path)
    rows = s.read.json(f"{path}/per_video").agg(F.count(F.lit(1)).alias("rows"), F.sum("n_truth").alias("sum_truth"), F.sum("f1").alias("sum_f1"))
    return rounded(s.read.json(f"{path}/summary").select("f1_skip", "n_pred", "n_truth", "matched").join(rows), 5)


def ranking_file(s, d):
    path = folders.shared_folder(s, "ranking")
    submissions.write_ranking(_ranking(s, d), path)
    back = s.read.option("header", "true").schema("name string, F1 double, keep_ratio double, n_pred long").csv(path)
    return back.withColumn("place", F.monotonically_increasing_id() + 1)


def _labels(s, d):
    """Orders as weak labels; one in three is a test clip, one in seven has no boxes."""
    roi = F.concat(F.lit("["), (_C("l_linenumber") * 2 - 3).cast("string"), F.lit(", ["), F.concat_ws(", ", (_C("l_partkey") % 200 + 0.5).cast("string"), (_C("l_suppkey") % 50).cast("string"), F.lit("169"), F.lit("300.4")), F.lit("]]"))
    rois = src.table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_partkey", "l_linenumber", "l_suppkey", "l_extendedprice", roi.alias("roi")))), lambda x: x["roi"]), ",").alias("rois"))
    o = src.table(s, d, "orders").join(rois, _C("o_orderkey") == _C("l_orderkey"), "left")
    split = F.when(_C("o_orderkey") % 3 == 0, "test").when(_C("o_orderkey") % 3 == 1, "train").otherwise("val")
    source = F.concat(F.lit("clip"), (_C("o_custkey") % 50).cast("string"), F.when(_C("o_custkey") % 4 == 0, ".MP4").otherwise(""))
    text = F.concat(F.lit('{"video_id": "'), _C("o_orderkey").cast("string"), F.lit('", "dataset_split": "'), split, F.lit('", "clip": {"source_vid": "'), source, F.lit('", "start_sec": 0}, "targetRatioWH": [9, 16], "cropRois": ['), F.when(_C("o_orderkey") % 7 == 0, "").otherwise(F.coalesce("rois", F.lit(""))), F.lit("]}"))
    path = folders.shared_folder(s, "labels")
    o.select(text.alias("value")).write.text(path)
    return s.read.schema(labels.LABELS).json(path)


def _truth_and_rejects(s, d):
    name = F.concat(F.lit("clip"), (_C("c_custkey") % 50).cast("string"))
    files = src.table(s, d, "customer").where("c_custkey % 50 < 40").select(F.concat(name, F.when(_C("c_custkey") % 4 == 0, ".MP4").otherwise(".mp4")).alias("file"), F.lit("a.zip").alias("archive"))
    meta = src.table(s, d, "orders").where("o_orderkey % 11 <> 0").select(_C("o_orderkey").cast("string").alias("video_id"), (_C("o_orderkey") % 5 * 2).cast("int").alias("n_frames"))
    return labels.truth_from_labels(labels.usable(_labels(s, d), ["train", "val"]), files, meta)


def label_truth(s, d):
    """Through the sink and back: one row a box."""
    path = folders.shared_folder(s, "truth")
    _truth_and_rejects(s, d)[0].write.json(path)
    good, _ = submissions.records(s, path)
    return submissions.checked(good).where("code IS NULL").select("video_id", "pos", "frame", "x", "y", "w")


def label_rejects(s, d):
    return _truth_and_rejects(s, d)[1]


def full_frames(s, d):
    """Clips chosen because the crop is the whole picture."""
    m = src.meta(s, d)
    cw, ch = crop_size(_C("w"), _C("h"), _C("tw"), F.when(_C("entity") % 3 == 0, _C("tw") * _C("h") / _C("w")).otherwise(_C("th")))
    full = m.where((cw == _C("w")) & (ch == _C("h"))).select(_C("entity").cast("string").alias("video_id"))
    return submissions.listed(_clips(s, d), full_frame=full)


QUERIES = {
    "sc2_submission_errors": errors,
    "fl2_typed_entries": entries,
    "sc17_truth_boxes": truth,
    "sc3_run_boxes": run,
    "sc1_index": index,
    "sc6_detection_facts": detection_facts,
    "sc6_track_facts": track_facts,
    "sc6_signal_facts": signal_facts,
    "sc14_resumable": resumed,
    "sc13_full_frames": full_frames,
    "sk1_submission": round_trip,
    "sk3_score_report": score_report,
    "sk4_ranking_file": ranking_file,
    "ar10_label_truth": label_truth,
    "ar10_label_rejects": label_rejects,
}

_E = """
    raw AS (SELECT o_orderkey AS o, o_orderkey % 17 AS k, CASE WHEN o_orderkey % 17 = 5 THEN o_orderkey - 1 ELSE o_orderkey END AS v FROM orders),
    ok AS (SELECT o, k, v::VARCHAR AS video_id, o % 2 = 0 AS wide FROM raw WHERE k > 2 AND NOT (k = 5 AND EXISTS (SELECT 1 FROM raw r WHERE r.o = raw.v AND r.k = 4))),
    li AS (SELECT ok.*, l_linenumber, l_partkey, row_number() OVER (PARTITION BY o ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS pos FROM ok JOIN lineitem ON l_orderkey = o WHERE k <> 3),
    f AS (SELECT *, l_partkey % 40 AS b, CASE WHEN k = 6 AND NOT wide THEN 16.0::DOUBLE WHEN wide THEN 16.0::DOUBLE ELSE 9.0::DOUBLE END AS tw, CASE WHEN k = 6 AND NOT wide THEN 9.0::DOUBLE WHEN wide THEN 9.0::DOUBLE ELSE 16.0::DOUBLE END AS th FROM li)"""
_CHECKED = f"""{_E}, {META},
    g AS (SELECT f.*, w AS mw, h AS mh, n_frames,
          CASE b WHEN 0 THEN 'shape' WHEN 1 THEN 'missing' WHEN 2 THEN 'frame' WHEN 3 THEN 'frame' WHEN 4 THEN 'frame' WHEN 5 THEN 'frame' WHEN 6 THEN 'missing' WHEN 7 THEN 'bbox' WHEN 8 THEN 'bbox' WHEN 9 THEN 'bbox' WHEN 10 THEN 'bbox' END AS bad,
          CASE WHEN b > 10 THEN l_linenumber ELSE CASE b WHEN 3 THEN NULL WHEN 5 THEN -1 WHEN 6 THEN 1 WHEN 7 THEN 2 WHEN 8 THEN 3 WHEN 9 THEN 3 WHEN 10 THEN 3 END END AS frame,
          l_partkey % 250 AS x, l_partkey % 250 + 169 AS r, 0.5 + 169 * f.th / f.tw AS bt FROM f LEFT JOIN meta ON entity::VARCHAR = video_id),
    c AS (SELECT *, coalesce(bad, CASE WHEN frame >= n_frames THEN 'frame' WHEN r > mw + 1 OR bt > mh + 1 THEN 'bounds' END) AS c1 FROM g),
    e AS (SELECT *, CASE WHEN c1 IS NULL AND row_number() OVER (PARTITION BY video_id, frame, c1 IS NULL ORDER BY pos) > 1 THEN 'dup' ELSE c1 END AS code FROM c)"""
_TRUTHS = "(SELECT l_orderkey AS entity, l_linenumber AS frame, min(l_partkey % 200)::DOUBLE AS x FROM lineitem WHERE l_linestatus = '{}' GROUP BY ALL)"
_LABELS = """
    o AS (SELECT o_orderkey AS o, 'clip' || (o_custkey % 50) || CASE WHEN o_custkey % 4 = 0 THEN '.MP4' ELSE '.mp4' END AS file FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey IN (SELECT l_orderkey FROM lineitem)),
    man AS (SELECT DISTINCT 'clip' || (c_custkey % 50) || CASE WHEN c_custkey % 4 = 0 THEN '.MP4' ELSE '.mp4' END AS file FROM customer WHERE c_custkey % 50 < 40),
    j AS (SELECT o.*, man.file IS NOT NULL AS found, CASE WHEN o % 11 <> 0 THEN o % 5 * 2 END AS n FROM o LEFT JOIN man USING (file)),
    b AS (SELECT o, l_linenumber * 2 - 3 AS frame, round_even(l_partkey % 200 + 0.5::DOUBLE, 0) AS x, (l_suppkey % 50)::DOUBLE AS y, row_number() OVER (PARTITION BY o, l_linenumber ORDER BY l_partkey, l_linenumber, l_suppkey, l_extendedprice) AS turn FROM j JOIN lineitem ON l_orderkey = o WHERE l_linenumber * 2 - 3 >= 0 AND l_linenumber * 2 - 3 < n)"""

ORACLE_SQL = {
    "sc2_submission_errors": f"""
        WITH {_E} SELECT CASE WHEN k IN (3, 5) THEN v::VARCHAR END AS video_id, 'json' AS code, CASE k WHEN 0 THEN 'invalid' WHEN 1 THEN 'object' WHEN 2 THEN 'video_id' WHEN 3 THEN 'predictions' ELSE 'repeated' END AS reason
        FROM raw WHERE k < 4 OR (k = 5 AND EXISTS (SELECT 1 FROM raw r WHERE r.o = raw.v AND r.k = 4))
    """,
    "fl2_typed_entries": f"""
        WITH {_CHECKED} SELECT video_id, pos::INT AS pos, CASE WHEN b = 3 THEN 1 WHEN b IN (0, 1, 2, 4) THEN NULL ELSE frame END::BIGINT AS frame, code, coalesce(code IS NULL AND (r > mw OR bt > mh), false) AS soft FROM e
    """,
    "sc17_truth_boxes": f"""
        WITH {_CHECKED} SELECT video_id, tw, th, frame::BIGINT AS frame, x::DOUBLE AS x, 0.5::DOUBLE AS y, 169.0::DOUBLE AS w FROM e WHERE code IS NULL OR code = 'dup' QUALIFY row_number() OVER (PARTITION BY video_id, frame ORDER BY pos DESC) = 1
    """,
    "sc3_run_boxes": f"""
        WITH {_E.replace("k > 2 AND NOT (k = 5 AND EXISTS (SELECT 1 FROM raw r WHERE r.o = raw.v AND r.k = 4))", "k > 2 AND NOT (k = 4 AND EXISTS (SELECT 1 FROM raw r WHERE r.o = raw.o + 1))")},
        b3 AS (SELECT *, CASE b WHEN 3 THEN 1 WHEN 4 THEN 1 WHEN 5 THEN -1 WHEN 8 THEN 3 WHEN 9 THEN 3 ELSE l_linenumber END AS frame, CASE b WHEN 3 THEN 1 WHEN 4 THEN 1 WHEN 5 THEN 1 WHEN 8 THEN -1 WHEN 9 THEN 0 ELSE l_partkey % 250 END AS x,
               CASE b WHEN 3 THEN 2 WHEN 4 THEN 2 WHEN 5 THEN 2 ELSE 0 END AS y, CASE b WHEN 3 THEN 3 WHEN 4 THEN 3 WHEN 5 THEN 3 WHEN 8 THEN 5 WHEN 9 THEN 0 ELSE 169 END AS w FROM f WHERE b NOT IN (0, 1, 2, 6, 7, 10))
        SELECT video_id, tw, th, frame::BIGINT AS frame, x::BIGINT AS x, y::BIGINT AS y, w::BIGINT AS w FROM b3 QUALIFY row_number() OVER (PARTITION BY video_id, frame ORDER BY pos DESC) = 1
    """,
    "sc1_index": f"WITH {META} SELECT entity::VARCHAR AS video_id, CASE WHEN entity % 5 <> 0 THEN tw ELSE 16 END::DOUBLE AS tw, CASE WHEN entity % 5 <> 0 THEN th ELSE 9 END::DOUBLE AS th FROM meta",
    "sc6_detection_facts": f"WITH {DETS} SELECT entity::VARCHAR AS video_id, frame, cls, round(conf, 6) AS conf, round(c, 6) AS cx, round(area, 6) AS area FROM dets",
    "sc6_track_facts": "SELECT l_suppkey::VARCHAR AS video_id, l_linenumber::VARCHAR AS track, count(*) AS n, sum(l_orderkey)::BIGINT AS frames, round(sum(l_partkey % 1000 / 1000.0::DOUBLE), 6) AS cx, round(sum(l_quantity / 50), 6) AS area, round(sum(l_discount), 6) AS conf, max(l_returnflag) AS cls, (SELECT count(DISTINCT l_linenumber) FROM lineitem x WHERE x.l_suppkey = lineitem.l_suppkey) AS n_sampled FROM lineitem GROUP BY l_suppkey, l_linenumber",
    "sc6_signal_facts": f"WITH {SIGNAL}, n AS (SELECT *, count(*) OVER (PARTITION BY entity) AS n FROM s) SELECT entity::VARCHAR AS video_id, frame::INT AS frame, round(value, 6) AS motion, CASE WHEN frame < n - 2 THEN round(value, 6) END AS audio, NULL::DOUBLE AS person FROM n",
    "sc14_resumable": "SELECT user_id, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY user_id",
    "sc13_full_frames": f"WITH {META}, {CROP} SELECT entity::VARCHAR AS video_id, tw, th FROM crop WHERE entity % 3 = 0 OR (cw = w AND ch = h)",
    "sk1_submission": f"WITH {META} SELECT m.entity::VARCHAR AS video_id, tw, th, 12.5::DOUBLE AS size, frame::BIGINT AS frame, x, CASE WHEN x IS NOT NULL THEN 169.0::DOUBLE END AS w FROM meta m LEFT JOIN {_TRUTHS.format('F')} t ON t.entity = m.entity",
    "sk3_score_report": f"""
        WITH p AS {_TRUTHS.format('F')}, t AS {_TRUTHS.format('O')}, m AS (SELECT t.entity, t.frame, greatest(0, 169 - abs(p.x - t.x)) AS i FROM p JOIN t USING (entity, frame)),
        f AS (SELECT entity, count(*) AS n_truth, coalesce((SELECT count(*) FROM p WHERE p.entity = t.entity), 0) AS n_pred, coalesce((SELECT count(*) FROM m WHERE m.entity = t.entity), 0) AS matched, coalesce((SELECT sum(i / (338 - i)) FROM m WHERE m.entity = t.entity), 0) AS s FROM t GROUP BY entity)
        SELECT round(avg(2 * s / (n_pred + n_truth)), 5) AS f1_skip, sum(n_pred)::BIGINT AS n_pred, sum(n_truth)::BIGINT AS n_truth, sum(matched)::BIGINT AS matched, count(*) AS rows, sum(n_truth)::BIGINT AS sum_truth, round(sum(round(2 * s / (n_pred + n_truth), 6)), 5) AS sum_f1 FROM f
    """,
    "ar10_label_truth": f"WITH {_LABELS} SELECT o::VARCHAR AS video_id, (row_number() OVER (PARTITION BY o ORDER BY frame) - 1)::INT AS pos, frame::BIGINT AS frame, x, y, 169.0::DOUBLE AS w FROM b JOIN j USING (o) WHERE turn = 1 AND found",
    "ar10_label_rejects": f"WITH {_LABELS} SELECT o::VARCHAR AS video_id, file, CASE WHEN NOT found THEN 'not found' WHEN coalesce(n, 0) <= 0 THEN 'no frames' ELSE 'outside' END AS reason FROM j WHERE NOT found OR coalesce(n, 0) <= 0 OR o NOT IN (SELECT o FROM b)",
}
