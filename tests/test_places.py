"""Places in a global order spread over tasks, ties too."""

from pyspark.sql import functions as F

from framelark.operators import report
from framelark.sources.folders import shared_folder


def test_equal_values_spread(spark):
    rows = spark.range(20_000).select(F.lit(1.0).alias("v"), F.col("id"))
    got = report.placed(rows, F.col("v"), ["id"])
    assert got.select((F.col("place") == F.col("id") + 1).alias("ok")).agg(F.bool_and("ok")).first()[0]
    path = got.inputFiles()
    assert len(path) > 8


def test_nulls_come_last(spark):
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else float(-i)) for i in range(50)], "id int, v double")
    got = [(r.place, r.id) for r in report.placed(rows, F.col("v"), [F.col("v").asc_nulls_last(), "id"]).orderBy("place").collect()]
    want = sorted(range(50), key=lambda i: (i % 3 == 0, -i if i % 3 else i))
    assert got == list(enumerate(want, 1))
    assert report.placed(rows.limit(0), F.col("v"), ["id"]).collect() == []


def test_partitions_follow_the_files(spark, tmp_path):
    from framelark.sources.folders import partitions_of

    spark.range(3000).repartition(3).write.parquet(f"file://{tmp_path}/a b")
    rows = spark.read.parquet(f"file://{tmp_path}/a b")
    assert partitions_of(rows) == 4 and partitions_of(rows.unionByName(rows), 100) > 20
    assert partitions_of(spark.range(5)) == 4


def test_scores_take_one_shuffle_that_follows_the_files(spark, monkeypatch):
    from framelark.operators import score
    from framelark.sources import frames

    for module in (frames, score, report):
        monkeypatch.setattr(module, "partitions_of", lambda rows: 40)
    scores = score.score_entities(*(frames.boxes(spark, "/root/testdata/sf0.001", x) for x in "FO"))
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert plan.count(", 40), REPARTITION_BY_NUM") == 2 and plan.count("Exchange") == 2
    n = scores.count()
    first = report.placed(scores.select("entity"), F.col("entity"), ["entity"], 2)
    assert [r.place for r in first.orderBy("entity").collect()] == list(range(1, n + 1))
    folder = next(iter(first.inputFiles())).rsplit("/", 1)[0]
    assert len([f for f in spark.read.parquet(folder).inputFiles()]) > 4


def test_quantiles_of_few_values_spread(spark, monkeypatch):
    folders = []
    monkeypatch.setattr(report, "shared_folder", lambda s, n: folders.append(shared_folder(s, n)) or folders[-1])
    rows = spark.range(40000).select(F.when(F.col("id") % 4 == 0, 1.0).otherwise(2.0).alias("v"))
    assert [tuple(r) for r in report.index_quantiles(rows, "v").collect()] == [(2.0, 2.0, 2.0)]
    most = spark.read.parquet(folders[0]).groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0]
    assert most < 10000
