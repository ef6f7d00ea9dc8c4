"""Caches and metadata as JSON objects keyed by video, read as flat facts, and the sink that writes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE = "W: int, H: int, n_frames: int"
META = f"struct<{SIZE}, duration: double, fps: double, probe: string>"
DETECTIONS = f"struct<{SIZE}, frames: array<int>, dets: array<array<struct<cls: string, conf: double, cx: double, cy: double, area: double, top: double, bh: double>>>>"
TRACKS = f"struct<{SIZE}, sampled: array<int>, tracks: map<string, array<array<string>>>>"
MASKS = f"struct<{SIZE}, frames: array<int>, masks: array<array<struct<cx: double, cy: double, area: double, iou: double, x0: double, x1: double, y0: double, y1: double>>>>"
BRIGHTNESS = f"struct<{SIZE}, frames: array<int>, mean: array<double>, dark: array<double>>"
SIGNALS = ("audio", "motion", "person", "ndet", "conf")
DENSE = f"struct<{SIZE}, fps: double, {', '.join(f'{s}: array<double>' for s in SIGNALS)}>"


def entries(spark: SparkSession, path: str, value: str, whole: bool = False) -> DataFrame:
    """video_id, v: the members of JSON objects as the type ``value``.

    Each line of the files is an object (what ``write_map`` writes); with ``whole`` each file is one, over any number of lines, and one task reads it. A member whose value
    doesn't fit comes as null; a text that is no object gives no rows. A key that several objects have comes as often.
    """
    text = spark.read.text(path, wholetext=whole)
    return text.select(F.explode(F.from_json("value", f"map<string, {value}>")).alias("video_id", "v"))


def write_map(rows: DataFrame, path: str, per_line: int = 1000) -> None:
    """Write (video_id, v) as JSON objects with sorted keys, a line for about ``per_line`` members; ids are dealt to lines by a hash, so no task holds all."""
    n = max(1, -(-rows.count() // per_line))
    line = F.pmod(F.xxhash64("video_id"), F.lit(n))
    grouped = rows.select(F.col("video_id").cast("string").alias("video_id"), "v").groupBy(line.alias("line")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("video_id", "v")), _by_id)).alias("m"))
    grouped.select(F.to_json("m").alias("value")).write.text(path)


def _by_id(a: Column, b: Column) -> Column:
    return F.when(a["video_id"] < b["video_id"], -1).when(a["video_id"] > b["video_id"], 1).otherwise(0)


def _size(v: str = "v") -> list[Column]:
    return [F.col(f"{v}.{c}") for c in ("W", "H", "n_frames")]


def _parallel(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with a row for each place of the arrays ``v.<name>``: place and one column an array. Arrays of different lengths are cut to the shortest."""
    arrays = [F.col(f"v.{n}") for n in names]
    shortest = F.least(*(F.size(a) for a in arrays)) if len(arrays) > 1 else F.size(arrays[0])
    zipped = F.slice(F.arrays_zip(*(a.alias(n) for n, a in zip(names, arrays, strict=True))), 1, F.greatest(shortest, F.lit(0)))
    rows = df.select("video_id", *_size(), F.posexplode(zipped).alias("place", "z"))
    return rows.select("video_id", "W", "H", "n_frames", "place", *(F.col("z")[n].alias(n) for n in names))


def metadata(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """video_id, W, H, n_frames, duration, fps, probe; of the number of frames and the duration one fills in the other."""
    m = entries(spark, path, META, whole).select("video_id", "v.*")
    n = F.coalesce(F.nullif("n_frames", F.lit(0)), F.rint(F.col("duration") * F.col("fps")).cast("int"))
    return m.withColumn("n_frames", n).withColumn("duration", F.coalesce("duration", F.try_divide(F.col("n_frames").cast("double"), F.col("fps"))))


def sampled_detections(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """A row for each sampled frame: video_id, W, H, n_frames, place, frame, dets (array of structs, empty where nothing was found)."""
    none = F.array().cast("array<struct<cls: string, conf: double, cx: double, cy: double, area: double, top: double, bh: double>>")
    return _parallel(entries(spark, path, DETECTIONS, whole), "frames", "dets").withColumnRenamed("frames", "frame").withColumn("dets", F.coalesce("dets", none))


def detections(sampled: DataFrame) -> DataFrame:
    """Of ``sampled_detections`` a row for each detection: video_id, frame, det (place in its frame) and its fields."""
    return sampled.select("video_id", "frame", F.posexplode("dets").alias("det", "d")).select("video_id", "frame", "det", "d.*")


def tracks(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """A row for each entry of each track: video_id, n_sampled, track, place, frame, cx, cy, area, conf, cls. Entries are lists of mixed kinds, taken by their place."""
    t = entries(spark, path, TRACKS, whole).select("video_id", F.size("v.sampled").alias("n_sampled"), F.explode("v.tracks").alias("track", "es"))
    e = t.select("video_id", "n_sampled", "track", F.posexplode("es").alias("place", "e"))
    at = lambda i: F.get("e", F.lit(i))
    return e.select("video_id", "n_sampled", "track", "place", at(0).try_cast("int").alias("frame"), *(at(i + 1).try_cast("double").alias(c) for i, c in enumerate(("cx", "cy", "area", "conf"))), at(5).alias("cls"))


def masks(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """A row for each mask: video_id, frame, mask (place in its frame) and its fields."""
    m = _parallel(entries(spark, path, MASKS, whole), "frames", "masks")
    return m.select("video_id", F.col("frames").alias("frame"), F.posexplode("masks").alias("mask", "m")).select("video_id", "frame", "mask", "m.*")


def brightness(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """A row for each sampled frame: video_id, W, H, n_frames, place, frame, mean, dark."""
    return _parallel(entries(spark, path, BRIGHTNESS, whole), "frames", "mean", "dark").withColumnRenamed("frames", "frame")


def signals(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """A row for each frame of dense signals: video_id, W, H, n_frames, frame, fps and the signals; one that is shorter than ``n_frames``, or missing, is null beyond its end."""
    s = entries(spark, path, DENSE, whole)
    frames = s.where(F.col("v.n_frames") > 0).select("*", F.explode(F.sequence(F.lit(0), F.col("v.n_frames") - 1)).alias("frame"))
    return frames.select("video_id", *_size(), "frame", "v.fps", *(F.get(F.col(f"v.{k}"), F.col("frame")).alias(k) for k in SIGNALS))


def intervals(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """video_id, start, end (half-open); both null where a video has none."""
    i = entries(spark, path, "array<int>", whole)
    return i.select("video_id", F.get("v", F.lit(0)).alias("start"), F.get("v", F.lit(1)).alias("end"))


def summaries(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """video_id, summary."""
    return entries(spark, path, "string", whole).select("video_id", F.col("v").alias("summary"))
