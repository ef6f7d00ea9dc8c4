"""Readers and sinks of submissions, caches and labels, by hand."""

import json
import os

import pytest
from pyspark.sql import functions as F

from framelark.operators import labels, validate
from framelark.sources import caches, folders, submissions


def entry(frame="1", box="[0, 0, 90]"):
    return f'{{"frame": {frame}, "bboxes": {box}}}'


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return f"file://{path}"


def test_the_ten_negatives(spark, tmp_path):
    """Every rule of the validator, in one video each."""
    bad = {
        "nan": (entry("NaN"), "frame"),
        "half": (entry("1.5"), "frame"),
        "true": (entry("true"), "frame"),
        "late": (entry("100"), "frame"),
        "left": (entry(box="[-1, 0, 90]"), "bbox"),
        "flat": (entry(box="[0, 0, 0]"), "bbox"),
        "two": (entry(box="[0, 0]"), "bbox"),
        "edge": (entry(box="[100, 0, 90]"), "bounds"),
        "text": (entry('"1"'), "frame"),
        "minus": (entry("-1"), "frame"),
        "none": ('{"bboxes": [0, 0, 90]}', "missing"),
        "nobox": ('{"frame": 1}', "missing"),
        "nullbox": (entry(box="null"), "missing"),
        "boxtext": (entry(box='"0,0,90"'), "bbox"),
        "boxtrue": (entry(box="[0, 0, true]"), "bbox"),
        "boxinf": (entry(box="[0, 0, Infinity]"), "bbox"),
        "shape": ("7", "shape"),
        "nullframe": (entry("null"), "frame"),
        "good": (entry("99"), None),
        "whole": (entry("2.0"), None),
        "soft": (entry(box="[91, 0, 90]"), None),
    }
    text = "\n".join(f'{{"video_id": "{k}", "targetRatioWH": [9, 16], "predictions": [{e}]}}' for k, (e, _) in bad.items())
    good, errors = submissions.records(spark, write(tmp_path / "p.jsonl", text))
    meta = spark.createDataFrame([(k, 180, 170, 100) for k in bad], "video_id string, W int, H int, n_frames int")
    rows = submissions.checked(good, meta).collect()
    assert {r.video_id: r.code for r in rows} == {k: c for k, (_, c) in bad.items()} and errors.count() == 0
    assert {r.video_id for r in rows if r.soft} == {"soft"}


def test_lines_and_their_faults(spark, tmp_path):
    text = "\n".join(
        [
            '{"video_id": 1, "predictions": []}',
            "",
            "   ",
            '{"video_id": 1, "predictions": [5]}',
            "{broken",
            "[1, 2]",
            '{"predictions": []}',
            '{"video_id": null}',
            '{"video_id": "a", "predictions": {"frame": 1}}',
            '{"video_id": "x", "video_id": "b", "targetRatioWH": [0, 1], "predictions": [' + entry() + "]}",
            '{"video_id": "c", "model_size_mb": "9", "targetRatioWH": ["16", 9]}',
            '  {"video_id": "d", "model_size_mb": 9.5, "predictions": [' + entry("3") + ", " + entry("3", "[1, 1, 9]") + ", " + entry("4") + "]}  ",
        ]
    )
    path = write(tmp_path / "p.jsonl", text)
    good, errors = submissions.records(spark, path)
    assert {(r.line, r.video_id, r.reason) for r in errors.collect()} == {(4, "1", "repeated"), (5, None, "invalid"), (6, None, "object"), (7, None, "video_id"), (8, None, "video_id"), (9, "a", "predictions")}
    assert {r.video_id: (r.line, r.tw, r.th, len(r.entries)) for r in good.collect()} == {"1": (1, 16.0, 9.0, 0), "a": (9, 16.0, 9.0, 0), "b": (10, 16.0, 9.0, 1), "c": (11, 16.0, 9.0, 0), "d": (12, 16.0, 9.0, 3)}
    assert [r.code for r in submissions.checked(good).where("video_id = 'd'").orderBy("pos").collect()] == [None, "dup", None]
    assert {(r.entity, str(r.size)) for r in submissions.model_sizes(good).collect()} == {("1", "None"), ("a", "None"), ("b", "None"), ("c", "nan"), ("d", "9.5")}
    assert {r.rule for r in validate.size_violations(submissions.model_sizes(good)).collect()} == {"invalid", "partial"}
    boxes, skipped = submissions.truth(spark, path)
    assert {(r.video_id, r.frame, r.w) for r in boxes.collect()} == {("b", 1, 90.0), ("d", 3, 9.0), ("d", 4, 90.0)} and skipped.count() == 6


def test_line_numbers_over_many_blocks(spark, tmp_path):
    """A file cut into blocks still has true numbers."""
    text = "".join("\n" * (i % 3) + json.dumps({"video_id": i, "predictions": []}) + "\n" for i in range(3000))
    path = write(tmp_path / "p.jsonl", text)
    want = {int(json.loads(x)["video_id"]): n for n, x in enumerate(text.split("\n"), 1) if x}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = submissions.lines(spark, path)
        assert got.rdd.getNumPartitions() > 1 or got.select("file").distinct().count() == 1
        assert {int(json.loads(r.value)["video_id"]): r.line for r in got.collect()} == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_runs_without_checks(spark, tmp_path):
    text = "\n".join(
        [
            '{"video_id": "a", "targetRatioWH": [9, 16], "predictions": [' + entry("1.7", '["3", 0, 90.9]') + ", " + entry("1") + ', {"frame": 2}, 5, ' + entry("3", "[1, 2]") + ", " + entry("null") + "]}",
            "{broken",
            '{"video_id": "b", "predictions": [' + entry() + "]}",
            '{"video_id": "b", "predictions": null}',
            '{"video_id": "c", "predictions": [' + entry("4", "[-1.9, 2, 3]") + "]}",
        ]
    )
    rows, bad = submissions.run(spark, write(tmp_path / "p.jsonl", text))
    assert {tuple(r) for r in rows.collect()} == {("a", 9.0, 16.0, 1, 0, 0, 90), ("c", 16.0, 9.0, 4, -1, 2, 3)}
    assert [r.line for r in bad.collect()] == [2]


def test_indexes_and_lists_of_ids(spark, tmp_path):
    path = write(tmp_path / "index.json", json.dumps([{"video_id": "10", "targetRatioWH": [9, 16]}, {"video_id": "9"}, {"video_id": "b", "targetRatioWH": ["x", 1]}], indent=1))
    index = submissions.index(spark, path)
    assert [tuple(r) for r in index.orderBy("place").collect()] == [(0, "10", 9.0, 16.0), (1, "9", 16.0, 9.0), (2, "b", 16.0, 9.0)]
    ids = lambda df: {r.video_id for r in df.collect()}
    assert ids(submissions.listed(index, ids=[9, "b"])) == {"9", "b"}
    assert ids(submissions.listed(index, limit=2)) == {"9", "10"}
    assert ids(submissions.listed(index, full_frame=index.where("tw = 9"))) == {"10"}


def test_submission_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", 2, 1.0, 0.0, 9.0), ("a", 1, 3.0, 0.0, 9.0)], "video_id string, frame int, x double, y double, w double")
    clips = spark.createDataFrame([("a", 9.0, 16.0), ("é", 16.0, 9.0)], "video_id string, tw double, th double")
    for size in (None, 4.5):
        path = f"{tmp_path}/out{size}"
        submissions.write(submissions.nest(rows, clips, size), f"file://{path}")
        text = [json.loads(x) for f in sorted(os.listdir(path)) if f.endswith(".json") for x in open(f"{path}/{f}", encoding="utf-8")]
        want = {"video_id": "a", "targetRatioWH": [9.0, 16.0], "predictions": [{"frame": 1, "bboxes": [3, 0, 9]}, {"frame": 2, "bboxes": [1, 0, 9]}]}
        extra = {} if size is None else {"model_size_mb": size}
        assert sorted(text, key=lambda r: r["video_id"]) == [want | extra, {"video_id": "é", "targetRatioWH": [16.0, 9.0], "predictions": []} | extra]


def test_caches(spark, tmp_path):
    det = {"cls": "person", "conf": 0.5, "cx": 0.1, "cy": 0.2, "area": 0.3}
    size = {"W": 10, "H": 20, "n_frames": 9}
    path = write(tmp_path / "det.json", json.dumps({"a": size | {"frames": [0, 5, 7], "dets": [[det], []]}, "b": size | {"frames": [], "dets": []}, "c": None}, indent=1))
    sampled = caches.sampled_detections(spark, path, whole=True)
    assert [(r.video_id, r.frame, len(r.dets)) for r in sampled.orderBy("place").collect()] == [("a", 0, 1), ("a", 5, 0)]
    assert [(r.frame, r.cls, r.cx, r.top) for r in caches.detections(sampled).collect()] == [(0, "person", 0.1, None)]
    path = write(tmp_path / "tracks.json", json.dumps({"a": size | {"sampled": [0, 5, 7], "tracks": {"3": [[5, 0.1, 0.2, 0.3, 0.9, "dog"], [7, 0.5]], "4": []}}}))
    assert [tuple(r) for r in caches.tracks(spark, path).orderBy("place").collect()] == [("a", 3, "3", 0, 5, 0.1, 0.2, 0.3, 0.9, "dog"), ("a", 3, "3", 1, 7, 0.5, None, None, None, None)]
    path = write(tmp_path / "masks.json", json.dumps({"a": size | {"frames": [4], "masks": [[{"cx": 0.5, "area": 0.1, "iou": 0.9}]]}}))
    assert [(r.frame, r.mask, r.cx, r.x0) for r in caches.masks(spark, path).collect()] == [(4, 0, 0.5, None)]
    path = write(tmp_path / "black.json", json.dumps({"a": size | {"frames": [0, 5], "mean": [1.5, 2], "dark": [0.9]}}))
    assert [(r.frame, r["mean"], r.dark) for r in caches.brightness(spark, path).collect()] == [(0, 1.5, 0.9)]
    path = write(tmp_path / "signals.json", json.dumps({"a": {"W": 1, "H": 1, "n_frames": 3, "fps": 25, "audio": [1, 2], "motion": [3, 4, 5]}}))
    assert [(r.frame, r.audio, r.motion, r.person) for r in caches.signals(spark, path).orderBy("frame").collect()] == [(0, 1.0, 3.0, None), (1, 2.0, 4.0, None), (2, None, 5.0, None)]
    path = write(tmp_path / "iv.json", '{"a": [3, 9], "b": null}')
    assert {tuple(r) for r in caches.intervals(spark, path).collect()} == {("a", 3, 9), ("b", None, None)}
    path = write(tmp_path / "sum.json", '{"a": "a dog", "b": "日本"}')
    assert {tuple(r) for r in caches.summaries(spark, path).collect()} == {("a", "a dog"), ("b", "日本")}
    path = write(tmp_path / "meta.json", json.dumps({"a": {"W": 1, "H": 2, "duration": 4.0, "fps": 25, "n_frames": 0}, "b": {"W": 1, "H": 2, "fps": 10.0, "n_frames": 50}}))
    assert {(r.video_id, r.n_frames, r.duration) for r in caches.metadata(spark, path, whole=True).collect()} == {("a", 100, 4.0), ("b", 50, 5.0)}


def test_maps_are_written_in_lines(spark, tmp_path):
    rows = spark.range(25).select(F.col("id").alias("video_id"), F.struct((F.col("id") * 2).alias("x")).alias("v"))
    caches.write_map(rows, f"file://{tmp_path}/m", per_line=10)
    lines = [json.loads(x) for f in os.listdir(tmp_path / "m") if f.endswith(".txt") for x in open(tmp_path / "m" / f)]
    assert all(list(m) == sorted(m) for m in lines) and 1 < len(lines) <= 3
    assert {k: v["x"] for m in lines for k, v in m.items()} == {str(i): 2 * i for i in range(25)}
    assert {(r.video_id, r.v.x) for r in caches.entries(spark, f"file://{tmp_path}/m", "struct<x: long>").collect()} == {(str(i), 2 * i) for i in range(25)}


def test_a_killed_job_goes_on(spark, tmp_path):
    job = folders.Resumable(spark, f"file://{tmp_path}/job", "k")
    todo = spark.range(100).select(F.col("id").alias("k"))
    seen: list[int] = []

    def work(rows, die=None):
        seen.extend(r.k for r in rows.collect())
        if die is not None and len(seen) > die:
            raise RuntimeError("killed")
        return rows.where("k % 2 = 0").select("k", (F.col("k") * 10).alias("v"))

    with pytest.raises(RuntimeError):
        job.run(todo, lambda r: work(r, 40), 8)
    finished = {r.k for r in job.done().collect()}
    # results that a run wrote before it died, without committing their keys
    spark.createDataFrame([(-1, -1)], "k long, v long").write.parquet(f"file://{tmp_path}/job/data/orphan")
    seen.clear()
    out = job.run(todo, work, 5)
    assert 0 < len(finished) < 100 and not finished & set(seen) and finished | set(seen) == set(range(100)) and len(seen) == len(set(seen))
    assert sorted((r.k, r.v) for r in out.collect()) == [(k, 10 * k) for k in range(0, 100, 2)]
    seen.clear()
    assert job.run(todo, work, 5).count() == 50 and not seen and not os.path.exists(tmp_path / "job/data/orphan")


def test_truth_from_labels(spark, tmp_path):
    def label(i, split="train", src="c", rois=((0, [1.5, 2.5, 3, 4]),)):
        return {"video_id": i, "dataset_split": split, "clip": {"source_vid": src, "start_sec": 0}, "cropRois": [list(r) for r in rois], "targetRatioWH": [9, 16]}

    many = [(3, [1, 1, 1, 1]), (1, [9, 9, 9, 9]), (3, [2, 2, 2, 2]), (-1, [1, 1, 1, 1]), (5, [1, 1, 1, 1]), (2, [1, 1]), (4, ["x", 1, 1, 1])]
    rows = [label("a", rois=many), label("b", src="d.MP4"), label("c", src="gone"), label("d", rois=[(7, [1, 1, 1, 1])]), label("e", split="test"), label("f", rois=[]), label("g"), label("h")]
    path = write(tmp_path / "l.jsonl", "\n".join(map(json.dumps, rows)))
    df = labels.usable(spark.read.schema(labels.LABELS).json(path), ["train", "val"])
    manifest = spark.createDataFrame([("c.mp4", "z1"), ("c.mp4", "z2"), ("d.MP4", "z1")], "file string, archive string")
    meta = spark.createDataFrame([("a", 5), ("b", 5), ("c", 5), ("d", 5), ("g", 0)], "video_id string, n_frames int")
    good, rejects = labels.truth_from_labels(df, manifest, meta)
    assert {r.video_id: [(p.frame, p.bboxes) for p in r.predictions] for r in good.collect()} == {"a": [(1, [9, 9, 9]), (3, [1, 1, 1])], "b": [(0, [2, 2, 3])]}
    assert {(r.video_id, r.file, r.reason) for r in rejects.collect()} == {("c", "gone.mp4", "not found"), ("d", "c.mp4", "outside"), ("g", "c.mp4", "no frames"), ("h", "c.mp4", "no frames")}
    assert [r.video_id for r in labels.usable(df, ["train"], 2).collect()] == ["a", "b"]
    assert labels.index_of(good).columns == ["video_id", "targetRatioWH"]


def test_strict_lookup(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "entity string")
    assert validate.strict(rows, rows).count() == 2
    with pytest.raises(ValueError, match="b"):
        validate.strict(rows, rows.where("entity = 'a'"))


def test_lines_are_parsed_once_and_stay_with_their_video(spark, tmp_path):
    """No filter parses again, no join by block moves lines, and one shuffle by video serves repeats, entries and boxes."""
    text = "\n".join(f'{{"video_id": "{k}", "predictions": [{entry()}]}}' for k in "abca") + "\n{broken\n[1]\n"
    path = write(tmp_path / "p.jsonl", text)
    boxes, errors = submissions.truth(spark, path)
    for rows in (boxes, errors, submissions.run(spark, path)[0]):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert not any("parseJson" in x for x in plan.split("\n") if "Filter" in x)
        assert plan.count("parseJson") == 2 and plan.count("REPARTITION_BY_NUM") == 1 and "SortMergeJoin" not in plan
    assert sorted(r.video_id for r in boxes.collect()) == ["a", "b", "c"]
    assert sorted((r.line, r.reason) for r in errors.collect()) == [(4, "repeated"), (5, "invalid"), (6, "object")]
