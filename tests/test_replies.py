"""Replies of every form, by hand."""

import pytest
from pyspark.sql import functions as F

from framelark.functions import replies

ANSWERS = {
    None: None,
    "": None,
    "no json here": None,
    '{"start": 1, "end": 2}': '{"end":2,"start":1}',
    '  ```json\n{"a": [1, 2,],}\n```  ': '{"a":[1,2]}',
    "```JSON[1,2]``` {}": "[1,2]",
    "```\n[1]\n``` {\"a\": 1}": "[1]",
    "look: [[1, 2], {\"a\": 3}] ok": '[[1,2],{"a":3}]',
    'so {"a": 1} and [2]': '{"a":1}',
    'so [2 and {"a": 1}': '{"a":1}',
    "[1, {\"a\": 2}": '{"a":2}',
    "} before {": None,
    "[1, 2}": None,
    "```": None,
    '{"a": "日本"}': '{"a":"日本"}',
}

SEGMENTS = {
    None: None,
    "": [],
    '{"segments": [[1, 2], [3.5, "4"], [5], ["x", 6], 7, null]}': [(1, 2), (3.5, 4)],
    'a {"b": 1} {"segments": []} {"segments": [[8, 9]]}': [(8, 9)],
    'x {"meta": {"n": 1}, "segments": [[0, 1]]} y': [(0, 1)],
    'broken {"segments": [[1, 2], [3, 4] tail [5,6': [(1, 2), (3, 4)],
    "segments: [ -1.5 , 2. ] [3,4,5] [6,7]": [(-1.5, 2), (6, 7)],
    "[1, 2] before the word segments": [],
    '{"a": {"b": {"segments": [[1, 2]]}}}': [(1, 2)],
}

POINTS = {
    "[[0.1, 0.2], [0.3, 0.4]]": [(0.1, 0.2), (0.3, 0.4)],
    '{"points": [[10, 20], [30, 140]]}': [(0.1, 0.2), (0.3, 1.0)],
    '{"other": 1, "data": [[100, 900]]}': [(0.1, 0.9)],
    '[{"x": 0.5, "y": "0.25"}, {"cx": 0.1, "cy": 2}]': [(0.5, 0.25), (0.1, 1.0)],
    '[{"bbox_2d": [0.1, 0.2, 0.3, 0.4]}, {"bbox": [0.5, 0.5]}]': [(0.2, 0.3), (0.5, 0.5)],
    "[[0, 100, 200, 300]]": [(0.1, 0.2)],
    "[[1, 50, 60], [2, 70, 80]]": [(0.5, 0.6), (0.7, 0.8)],
    "[[[0.1, 0.2], [0.3, 0.4]]]": [(0.1, 0.2), (0.3, 0.4)],
    '{"bbox": [0.2, 0.2, 0.4, 0.6]}': [(0.3, 0.4)],
    '{"x": 0.5, "y": 0.5}': [(0.5, 0.5)],
    "[[0.1, 0.2], 5]": None,
    "[[0.1, null]]": None,
    "[[1, 2, 3, 4, 5]]": None,
    '[{"x": 1}]': None,
    "[]": None,
    '{"a": 1}': None,
    "[[0,0],[0,0],[0,0],[0,0],[0,0],[0,0],[0,0],[0,0],[0,0]]": None,
    None: None,
}

INTERVALS = {
    '{"start_sec": 5, "end": 2, "subject": "dog"}': (2.0, 5.0, "dog"),
    '[{"begin_sec": "1.5", "to_sec": 3}]': (1.5, 3.0, ""),
    '{"start": true, "end": "x", "stop_sec": 4, "subject": "", "主体": "cat"}': (1.0, 4.0, "cat"),
    '{"start": 1, "end": 1.0004}': None,
    '{"start": 1}': None,
    "[1, 2]": None,
    "[]": None,
}


def run(spark, cases, make):
    rows = list(cases)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    got = {r.i: r.v for r in df.select("i", make(F.col("t")).alias("v")).collect()}
    return {t: got[i] for i, t in enumerate(rows)}


def test_answers(spark):
    assert run(spark, ANSWERS, lambda t: F.to_json(replies.answer(t))) == ANSWERS


def test_segments(spark):
    got = run(spark, SEGMENTS, replies.segments)
    assert {k: None if v is None else [tuple(s) for s in v] for k, v in got.items()} == SEGMENTS


def test_points(spark):
    got = run(spark, POINTS, lambda t: replies.points(replies.answer(t), 8))
    for k, want in POINTS.items():
        assert (got[k] is None) == (want is None), k
        assert want is None or [tuple(p) for p in got[k]] == [pytest.approx(p) for p in want], k


def test_intervals(spark):
    got = run(spark, INTERVALS, lambda t: replies.interval(replies.answer(t)))
    assert {k: v and tuple(v) for k, v in got.items()} == INTERVALS


def test_long_replies(spark):
    """No recursion over the text's length."""
    long = "x" * 200_000 + "{" + '"a": {"b": 1}, ' * 20_000 + '"segments": [[1, 2]]}'
    (r,) = spark.createDataFrame([(long,)], "t string").select(F.size(replies.segments(F.col("t"))).alias("n")).collect()
    assert r.n == 1
