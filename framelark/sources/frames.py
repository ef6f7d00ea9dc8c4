"""The driver tables as entities, frames, detections, predictions and signals; nested JSON in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .folders import partitions_of

SUBMISSION = "video_id STRING, targetRatioWH ARRAY<DOUBLE>, model_size_mb DOUBLE, predictions ARRAY<STRUCT<frame: INT, bboxes: ARRAY<INT>>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxes(spark: SparkSession, sf_dir: str, status: str) -> DataFrame:
    """Boxes of the order lines with one status: entity (order), frame (line number), x, y, w, h; the first of each frame by all fields.

    Nearly every line is a frame of its own, so lines go to partitions of entities before they are grouped.
    """
    li = table(spark, sf_dir, "lineitem").where(F.col("l_linestatus") == status)
    li = li.select(F.col("l_orderkey").alias("entity"), F.col("l_linenumber").alias("frame"), (F.col("l_partkey") % 200).cast("double").alias("x"))
    rows = li.repartition(partitions_of(li), "entity").groupBy("entity", "frame").agg(F.min("x").alias("x"))
    return rows.select("entity", "frame", "x", F.lit(0.0).alias("y"), F.lit(169.0).alias("w"), F.lit(300.0).alias("h"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as detections of their supplier: frame, cls, conf, area, c."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("entity"), F.col("l_linenumber").alias("frame"), F.col("l_returnflag").alias("cls"), (1 - F.col("l_discount") * 5).alias("conf"), (F.col("l_quantity") / 50).alias("area"), ((F.col("l_partkey") % 1000) / 1000.0).alias("c"), "l_orderkey", "l_extendedprice")


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as clips: w, h, target ratio tw:th, n_frames."""
    even = F.col("o_orderkey") % 2 == 0
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entity"), (360 + F.col("o_orderkey") % 5 * 90).cast("double").alias("w"), F.lit(640.0).alias("h"), F.when(even, 16.0).otherwise(9.0).alias("tw"), F.when(even, 9.0).otherwise(16.0).alias("th"), F.lit(8).alias("n_frames"))


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as series: entity (user), frame (place in time), value, event_type."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("entity"), (F.row_number().over(order) - 1).alias("frame"), "value", "event_type")


def read_submission(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows and errors of a JSONL file: (video_id, pos, frame, x, y, w) and (line, code). Blank lines are skipped; of repeated ids the first line counts."""
    lines = spark.read.text(path).select(F.col("value"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line")).where(F.trim("value") != "")
    parsed = lines.withColumn("r", F.from_json("value", SUBMISSION)).withColumn("bad", F.col("r.video_id").isNull())
    turn = F.row_number().over(Window.partitionBy("r.video_id", "bad").orderBy("line"))
    parsed = parsed.withColumn("again", ~F.col("bad") & (turn > 1))
    errors = parsed.where("bad OR again").select("line", F.lit("json").alias("code"))
    rows = parsed.where("NOT bad AND NOT again").select("r.video_id", F.posexplode("r.predictions").alias("pos", "p"))
    get = lambda i: F.get("p.bboxes", F.lit(i))
    return rows.select("video_id", "pos", "p.frame", get(0).alias("x"), get(1).alias("y"), get(2).alias("w")), errors


def nest(rows: DataFrame) -> DataFrame:
    """One row for each video with its predictions as an array by frame: what ``write.json`` puts on a line."""
    return rows.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("frame", F.array("x", "y", "w").alias("bboxes")))).alias("predictions"))


def resume(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is still to do: rows whose key ``done`` doesn't have."""
    return todo.join(done.select(key), key, "left_anti")
