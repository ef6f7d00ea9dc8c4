"""Truth out of weak labels: what can be used, and why the rest can't."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABELS = "video_id STRING, dataset_split STRING, clip STRUCT<source_vid: STRING, start_sec: DOUBLE, end_sec: DOUBLE, free_axis: STRING>, cropRois ARRAY<ARRAY<STRING>>, targetRatioWH ARRAY<DOUBLE>"


def usable(labels: DataFrame, splits: list[str], limit: int | None = None) -> DataFrame:
    """Labels of some splits that have boxes; with ``limit`` those of the first ids in order."""
    rows = labels.where(F.col("dataset_split").isin(splits) & (F.size("cropRois") > 0))
    return rows if limit is None else rows.orderBy("video_id").limit(limit)


def file_name(source: Column) -> Column:
    """The name of a clip's file."""
    return F.when(F.lower(source).endswith(".mp4"), source).otherwise(F.concat(source, F.lit(".mp4")))


def truth_from_labels(labels: DataFrame, manifest: DataFrame, meta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Truth records and rejects of ``labels`` (a row a video, see ``LABELS``).

    Records: video_id, targetRatioWH, predictions by frame, boxes rounded half to even and without their height; of a frame's boxes the first listed counts, frames outside the clip and
    boxes that aren't four numbers are dropped. Rejects: video_id, file, reason, the first of: ``not found`` (``manifest`` (file, archive) lacks the file), ``no frames`` (``meta`` (video_id, n_frames) has
    no count), ``outside`` (no box is left). Every label is in one of the two.
    """
    found = manifest.groupBy("file").agg(F.min("archive").alias("archive"))
    r = labels.withColumn("file", file_name(F.col("clip.source_vid"))).join(found, "file", "left").join(meta.select("video_id", "n_frames"), "video_id", "left")
    number = lambda x: x.try_cast("double")
    box = lambda e: F.transform(F.from_json(F.get(e, F.lit(1)), "array<string>"), lambda v: F.rint(number(v)).try_cast("int"))
    boxes = F.transform("cropRois", lambda e, i: F.struct(number(F.get(e, F.lit(0))).try_cast("int").alias("frame"), i.alias("i"), box(e).alias("b")))
    inside = F.filter(boxes, lambda p: (p["frame"] >= 0) & (p["frame"] < F.col("n_frames")) & (F.size(p["b"]) == 4) & F.forall(p["b"], lambda v: v.isNotNull()))
    r = r.withColumn("ps", F.array_sort(F.coalesce(inside, F.array().cast("array<struct<frame: int, i: int, b: array<int>>>"))))
    first = F.filter("ps", lambda p, i: (i == 0) | (F.get("ps", i - 1)["frame"] != p["frame"]))
    reason = F.when(F.col("archive").isNull(), "not found").when(F.coalesce("n_frames", F.lit(0)) <= 0, "no frames").when(F.size("ps") == 0, "outside")
    r = r.withColumn("reason", reason)
    good = r.where("reason IS NULL").select("video_id", "targetRatioWH", F.transform(first, lambda p: F.struct(p["frame"].alias("frame"), F.slice(p["b"], 1, 3).alias("bboxes"))).alias("predictions"))
    return good, r.where("reason IS NOT NULL").select("video_id", "file", "reason")


def index_of(records: DataFrame) -> DataFrame:
    """The index that goes with truth records: video_id, targetRatioWH."""
    return records.select("video_id", "targetRatioWH")
