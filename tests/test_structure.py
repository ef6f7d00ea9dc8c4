"""The driver contract, nested JSON in and out, and the package without its training-data part."""

import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

import __spark_entry__
from framelark.functions import text
from framelark.sources import frames as src

REPO = Path(__file__).resolve().parents[1]


def test_entry(spark):
    out = __spark_entry__.entry(spark)
    assert {"entity", "f1"} <= set(out.columns) and out.count() > 0


def test_sql_belongs_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_rest_works_without_llm(tmp_path):
    code = "import sys; sys.modules['framelark.llm'] = None; import __spark_entry__ as e; assert 'ag1_score_entities' in e.queries(); assert not any(q.startswith('op1') for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True)


def test_submission_round_trip(spark, tmp_path):
    good = '{"video_id": "1", "targetRatioWH": [16, 9], "predictions": [{"frame": 4, "bboxes": [1, 0, 9]}, {"frame": 2, "bboxes": [3, 0, 9]}]}'
    (tmp_path / "a.jsonl").write_text(good + '\n\n{"video_id"\n' + good + '\n{"video_id": "2", "predictions": []}\n')
    rows, errors = src.read_submission(spark, f"file://{tmp_path}/a.jsonl")
    assert sorted((r.video_id, r.frame, r.x) for r in rows.collect()) == [("1", 2, 3), ("1", 4, 1)]
    assert errors.count() == 2
    assert [p.frame for p in src.nest(rows).first().predictions] == [2, 4]


def test_text_functions(spark):
    r = spark.createDataFrame([("a 1 b -2.5 c 30",), ("none",), (None,)], "t string").select(text.last_numbers(F.col("t")).alias("n"))
    assert [x.n for x in r.collect()] == [[-2.5, 30.0], None, None]
    f = spark.createDataFrame([("30000/1001",), ("25",), ("1/0",), ("x",)], "t string").select(text.fraction(F.col("t")).alias("f"))
    assert [x.f and round(x.f, 2) for x in f.collect()] == [29.97, 25.0, None, None]
