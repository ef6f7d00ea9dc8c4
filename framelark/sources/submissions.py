"""Submissions, truth and indexes as JSON files: typed readers with an error for each fault and its line, and the sinks that write them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import safe_ratio
from .folders import partitions_of

#: Numbers that JSON doesn't have but Python writes; read as a number that isn't finite either.
_NOT_A_NUMBER = r"(?<=[\[:,\s])(?:NaN|-?Infinity)(?=\s*[,\]}])"
_SPACE = r"^[\s\x0B\x1C-\x1F]+|[\s\x0B\x1C-\x1F]+$"
RECORD = "video_id STRING, targetRatioWH ARRAY<DOUBLE>, model_size_mb DOUBLE, predictions ARRAY<STRUCT<frame: INT, bboxes: ARRAY<INT>>>"
#: Bytes of text whose records make a partition.
EACH = 8 << 20
FIELDS = ("video_id", "targetRatioWH", "model_size_mb", "predictions")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line, value: the lines of text files with their true numbers, from 1 in each file; blank lines are counted, but left out.

    A file may be read in many blocks: rows are numbered inside their block, and the lines of the blocks before are added (a row for each block).
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    blocks = raw.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # broadcast, as a join by block would bring a whole block's lines to one task
    numbered = raw.join(F.broadcast(blocks.select("file", "block", "first", before.alias("before"))), ["file", "block"])
    return numbered.select("file", (F.col("at") - F.col("first") + F.col("before") + 1).alias("line"), F.regexp_replace("value", _SPACE, "").alias("value")).where("value != ''")


def _is_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string, variant>").isNotNull()


def _is_number(v: Column) -> Column:
    kind = F.schema_of_variant(v)
    return F.coalesce(kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), F.lit(False))


def _list(v: Column) -> Column:
    """The elements of a variant that is a list, else null."""
    return F.try_variant_get(v, "$", "array<variant>")


def _finite(v: Column) -> Column:
    return F.coalesce(_is_number(v) & (F.abs(F.try_variant_get(v, "$", "double")) < float("inf")), F.lit(False))


def _json(value: Column) -> Column:
    """JSON as a variant, with NaN and Infinity as numbers that aren't finite; null where it doesn't parse.

    The condition always holds: a column with a row's number isn't copied into the filters and fields above it, so a line is parsed once.
    """
    return F.when(F.monotonically_increasing_id() >= 0, F.coalesce(F.try_parse_json(value), F.try_parse_json(F.regexp_replace(value, _NOT_A_NUMBER, "1e999"))))


def _last_of_repeated(value: Column) -> Column:
    """The fields of an object that has a name twice: the last one counts."""
    return F.from_json(F.regexp_replace(value, _NOT_A_NUMBER, "1e999"), ", ".join(f"{f} VARIANT" for f in FIELDS))


def records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Records and errors of JSON lines.

    Records: file, line, video_id, tw, th, size (variant), entries (array of variants). Errors: file, line, video_id, code (always ``json``), reason:
    ``invalid``, ``object`` (no object), ``video_id`` (missing or null), ``repeated`` (an earlier line of any file has the id; by file, then line) or
    ``predictions`` (no list; the record stays, without entries). A missing or unsound ratio is 16:9. Of a name that an object has twice the last one counts.
    """
    read = lines(spark, path).select("*", _json(F.col("value")).alias("v"))
    loose = F.when(F.col("v").isNull() & F.col("value").startswith("{"), _last_of_repeated(F.col("value")))
    read = read.withColumn("loose", loose)
    field = lambda f: F.coalesce(F.try_variant_get("v", f"$.{f}", "variant"), F.col(f"loose.{f}"))
    known = F.col("loose.video_id").isNotNull() | F.col("loose.predictions").isNotNull()
    parsed = F.col("v").isNotNull()
    # JSON that parses is an object where it begins as one; naming the kind of a variant would walk through all of it
    read = read.select("file", "line", parsed.alias("parsed"), F.when(parsed, F.col("value").startswith("{")).otherwise(F.coalesce(known, F.lit(False))).alias("is_object"), *(field(f).alias(f) for f in FIELDS))
    read = read.withColumn("id", F.try_variant_get("video_id", "$", "string"))
    reason = F.when(~F.col("parsed") & ~F.col("is_object"), "invalid").when(~F.col("is_object"), "object").when(F.col("id").isNull(), "video_id")
    read = read.withColumn("reason", reason)
    no_list = F.col("predictions").isNotNull() & _list(F.col("predictions")).isNull()
    n = partitions_of(read, EACH)
    turn = lambda key: F.row_number().over(Window.partitionBy(key).orderBy("file", "line"))
    # a line with a fault of its own is its own group
    group = F.when(F.col("reason").isNull(), F.concat(F.lit("v"), "id")).otherwise(F.concat(F.lit("l"), F.col("line").cast("string"), F.lit(" "), "file"))
    marked = read.select("file", "line", F.col("id").alias("video_id"), "reason", no_list.alias("no_list"), group.alias("group")).repartition(n, "group")
    fault = F.coalesce("reason", F.when(turn("group") > 1, "repeated"), F.when(F.col("no_list"), "predictions"))
    errors = marked.select("file", "line", "video_id", F.lit("json").alias("code"), fault.alias("reason")).where("reason IS NOT NULL")
    ratio = safe_ratio(F.try_variant_get("targetRatioWH", "$", "array<string>"))
    entries = F.coalesce(_list(F.col("predictions")), F.array().cast("array<variant>"))
    # everything that follows by video_id takes place in these partitions
    good = read.where("reason IS NULL").select("file", "line", F.col("id").alias("video_id"), "targetRatioWH", "model_size_mb", "predictions").repartition(n, "video_id")
    good = good.withColumn("turn", turn("video_id")).where("turn = 1")
    good = good.select("file", "line", "video_id", ratio.alias("r"), F.col("model_size_mb").alias("size"), entries.alias("entries"))
    return good.select("file", "line", "video_id", "r.tw", "r.th", "size", "entries"), errors


def checked(good: DataFrame, meta: DataFrame | None = None, tolerance: float = 1.0) -> DataFrame:
    """A row for each entry of ``records``: file, line, video_id, pos, frame, x, y, w, code (null: valid), soft.

    The first failing rule counts: ``shape`` (no object), ``missing`` (no frame), ``frame`` (no finite whole number of 0 or more; true and texts
    aren't numbers), ``missing`` (no bboxes), ``bbox`` (no list of three finite numbers, a corner below 0, a width of 0 or less), then with ``meta`` (video_id, W, H, n_frames)
    ``frame`` (at or beyond the end) and ``bounds`` (beyond the picture by more than ``tolerance``; the height follows from the ratio), then ``dup`` for a frame that an earlier
    valid entry of the video has. ``soft``: valid, but beyond the picture within the tolerance.
    """
    return _checked(good, meta, tolerance).drop("tw", "th")


def _checked(good: DataFrame, meta: DataFrame | None = None, tolerance: float = 1.0) -> DataFrame:
    """``checked`` with the ratio of each entry's video."""
    sizes = ["width", "height", "n_frames"]
    if meta is None:
        good = good.select("*", *(F.lit(None).cast("double").alias(c) for c in sizes))
    else:
        good = good.join(meta.select("video_id", F.col("W").alias("width"), F.col("H").alias("height"), "n_frames"), "video_id", "left")
    e = good.select("file", "line", "video_id", "tw", "th", *sizes, F.posexplode("entries").alias("pos", "e"))
    part = lambda k: F.try_variant_get("e", k, "variant")
    f, b = part("$.frame"), part("$.bboxes")
    e = e.select("*", (F.col("e").isNotNull() & ~_is_object(F.col("e"))).alias("shapeless"), F.coalesce(_finite(f), F.lit(False)).alias("f_ok"), f.isNotNull().alias("has_f"), F.try_variant_get(f, "$", "double").alias("fd"), (b.isNotNull() & ~F.is_variant_null(b)).alias("has_b"), _list(b).alias("bs"))
    num = lambda i: F.try_variant_get(F.get("bs", F.lit(i)), "$", "double")
    e = e.select("*", *(num(i).alias(c) for i, c in enumerate("xyw")), F.forall("bs", _finite).alias("b_ok"))
    right, bottom = F.col("x") + F.col("w"), F.col("y") + F.col("w") * F.col("th") / F.col("tw")
    code = (
        F.when(F.col("shapeless"), "shape")
        .when(~F.col("has_f"), "missing")
        .when(~F.col("f_ok") | (F.col("fd") != F.floor("fd")) | (F.col("fd") < 0), "frame")
        .when(~F.col("has_b"), "missing")
        .when(F.col("bs").isNull() | (F.size("bs") != 3) | ~F.coalesce("b_ok", F.lit(False)), "bbox")
        .when((F.col("x") < 0) | (F.col("y") < 0) | (F.col("w") <= 0), "bbox")
        .when(F.col("fd") >= F.col("n_frames"), "frame")
        .when((right > F.col("width") + tolerance) | (bottom > F.col("height") + tolerance), "bounds")
    )
    e = e.withColumn("code", code).withColumn("frame", F.when(F.col("f_ok"), F.col("fd")).try_cast("long"))
    turn = F.row_number().over(Window.partitionBy("video_id", "frame", F.col("code").isNull()).orderBy("pos"))
    e = e.withColumn("code", F.when(F.col("code").isNull() & (turn > 1), "dup").otherwise(F.col("code")))
    soft = F.coalesce(F.col("code").isNull() & ((right > F.col("width")) | (bottom > F.col("height"))), F.lit(False))
    return e.select("file", "line", "video_id", "tw", "th", "pos", "frame", "x", "y", "w", "code", soft.alias("soft"))


def truth(spark: SparkSession, path: str, meta: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Valid boxes (video_id, tw, th, frame, x, y, w) of a truth file, the last of a frame's valid entries, and the lines that were left out."""
    good, errors = records(spark, path)
    rows = _checked(good, meta).where("code IS NULL OR code = 'dup'")
    last = rows.groupBy("video_id", "frame").agg(F.max_by(F.struct("tw", "th", "x", "y", "w"), "pos").alias("b"))
    return last.select("video_id", "b.tw", "b.th", "frame", "b.x", "b.y", "b.w"), errors


def run(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Boxes (video_id, tw, th, frame, x, y, w) of a run for comparisons, read without checks, and the lines left out (file, line).

    Numbers are cut to integers (texts that are numbers too). Of a video's lines the last one counts, of a frame's entries the last; entries without a frame or three numbers are left out.
    """
    read = lines(spark, path).select("file", "line", _json(F.col("value")).alias("v"))
    bad = read.where(F.col("v").isNull() | F.try_variant_get("v", "$.video_id", "string").isNull()).select("file", "line")
    good = read.select("file", "line", F.try_variant_get("v", "$.video_id", "string").alias("video_id"), "v").where("video_id IS NOT NULL")
    turn = F.row_number().over(Window.partitionBy("video_id").orderBy(F.col("file").desc(), F.col("line").desc()))
    good = good.repartition(partitions_of(good, EACH), "video_id").withColumn("turn", turn).where("turn = 1")
    ratio = safe_ratio(F.try_variant_get("v", "$.targetRatioWH", "array<string>"))
    good = good.select("video_id", "v", ratio.alias("r"))
    e = good.select("video_id", "r.tw", "r.th", F.posexplode(F.try_variant_get("v", "$.predictions", "array<variant>")).alias("pos", "e"))
    whole = lambda p: F.try_variant_get("e", p, "double").try_cast("long")
    e = e.select("video_id", "tw", "th", "pos", whole("$.frame").alias("frame"), *(whole(f"$.bboxes[{i}]").alias(c) for i, c in enumerate("xyw")), F.size(F.try_variant_get("e", "$.bboxes", "array<variant>")).alias("n"))
    e = e.where("n = 3 AND frame IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND w IS NOT NULL")
    e = e.groupBy("video_id", "frame").agg(F.max_by(F.struct("tw", "th", "x", "y", "w"), "pos").alias("b"))
    return e.select("video_id", "b.tw", "b.th", "frame", "b.x", "b.y", "b.w"), bad


def index(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """place, video_id, tw, th of files whose root is a list, in its order; 16:9 where a ratio is missing or unsound.

    With ``whole`` a file is one list, over any number of lines, and one task reads it; without, each line is a list.
    """
    rows = spark.read.text(path, wholetext=whole).select(F.posexplode(F.from_json("value", "array<struct<video_id: string, targetRatioWH: array<string>>>")).alias("place", "r"))
    return rows.select("place", "r.video_id", safe_ratio(F.col("r.targetRatioWH")).alias("q")).select("place", "video_id", "q.tw", "q.th")


def model_size() -> Column:
    """The size of ``records`` as a number."""
    given = F.col("size").isNotNull() & ~F.is_variant_null("size")
    return F.when(given, F.when(_is_number(F.col("size")), F.try_variant_get("size", "$", "double")).otherwise(float("nan")))


def model_sizes(good: DataFrame) -> DataFrame:
    """entity, size for ``operators.validate.size_violations``; a size that is no number comes as NaN, a missing one as null."""
    return good.select(F.col("video_id").alias("entity"), model_size().alias("size"))


def listed(rows: DataFrame, ids: list[str] | None = None, full_frame: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """``rows`` of the given video_ids, or of those in ``full_frame``; then of the first ``limit`` ids in order of number, then text."""
    if ids is not None:
        rows = rows.where(F.col("video_id").isin([str(i) for i in ids]))
    if full_frame is not None:
        rows = rows.join(full_frame.select("video_id").distinct(), "video_id", "left_semi")
    if limit is not None:
        order = [F.col("video_id").try_cast("long").asc_nulls_last(), "video_id"]
        rows = rows.join(rows.select("video_id").distinct().orderBy(*order).limit(limit), "video_id", "left_semi")
    return rows


def nest(rows: DataFrame, clips: DataFrame, size_mb: float | None = None) -> DataFrame:
    """Records in the submission format: a row for each of ``clips`` (video_id, tw, th) with its boxes (video_id, frame, x, y, w) by frame; clips without any have an empty list.

    ``model_size_mb`` is on every row, or on none where it is null.
    """
    box = F.struct(F.col("frame").cast("int").alias("frame"), F.array(*(F.col(c).cast("int") for c in "xyw")).alias("bboxes"))
    boxes = rows.groupBy("video_id").agg(F.array_sort(F.collect_list(box)).alias("predictions"))
    none = F.array().cast("array<struct<frame: int, bboxes: array<int>>>")
    joined = clips.join(boxes, "video_id", "left")
    return joined.select("video_id", F.array("tw", "th").alias("targetRatioWH"), F.lit(size_mb).cast("double").alias("model_size_mb"), F.coalesce("predictions", none).alias("predictions"))


def write(nested: DataFrame, path: str) -> None:
    """JSON lines of ``nest``; letters stay as they are, a null size is left out."""
    nested.write.option("ignoreNullFields", "true").json(path)


def write_scores(scores: DataFrame, macro: DataFrame, path: str) -> None:
    """A score report: one line of totals under ``summary``, a line for each video under ``per_video``."""
    macro.write.json(f"{path}/summary")
    scores.write.option("ignoreNullFields", "false").json(f"{path}/per_video")


def write_ranking(rows: DataFrame, path: str, by: str = "F1") -> None:
    """A CSV with a header, best first. ``rows`` has one row an experiment, so one task writes it."""
    rows.coalesce(1).sortWithinPartitions(F.col(by).desc_nulls_last(), "name").write.option("header", "true").csv(path)
