"""Geometry of crop windows as Column expressions; rounding is half to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def crop_size(w: Column, h: Column, tw: Column, th: Column) -> tuple[Column, Column]:
    """Width and height of the largest rectangle of ratio ``tw:th`` inside ``w`` x ``h``; the whole frame where a number isn't positive."""
    ratio = tw / th
    wide = w / h >= ratio
    cw = F.when(wide, F.least(F.rint(h * ratio), w)).otherwise(w)
    ch = F.when(wide, h).otherwise(F.least(F.rint(w / ratio), h))
    good = (w > 0) & (h > 0) & (tw > 0) & (th > 0)
    at_least = lambda x, whole: F.when(good, F.greatest(x, F.lit(1))).otherwise(whole).cast("int")
    return at_least(cw, w), at_least(ch, h)


def free_axis(w: Column, h: Column, cw: Column, ch: Column) -> Column:
    """The axis along which a crop can move: x, y or none."""
    return F.when(cw < w, "x").when(ch < h, "y").otherwise("none")


def iou(ax: Column, ay: Column, aw: Column, ah: Column, bx: Column, by: Column, bw: Column, bh: Column) -> Column:
    """Intersection over union of two boxes given by corner and size; 0 where they don't meet."""
    iw = F.greatest(F.lit(0.0), F.least(ax + aw, bx + bw) - F.greatest(ax, bx))
    ih = F.greatest(F.lit(0.0), F.least(ay + ah, by + bh) - F.greatest(ay, by))
    both = iw * ih
    union = aw * ah + bw * bh - both
    return F.when((both > 0) & (union > 0), both / union).otherwise(F.lit(0.0))


def center_to_box(center: Column, size: Column, crop: Column) -> Column:
    """The corner of a crop around a normalised centre, held inside the frame."""
    return F.rint(F.greatest(F.lit(0.0), F.least(center * size - crop / 2, size - crop))).cast("int")


def shrink(center: Column, alpha: float) -> Column:
    """A centre pulled towards the middle of the frame."""
    return alpha * center + (1 - alpha) * 0.5


def frames_of_seconds(start: Column, end: Column, fps: Column, n: Column) -> tuple[Column, Column]:
    """Seconds as a half-open range of frames inside ``[0, n)``."""
    return F.greatest(F.lit(0), F.floor(start * fps)).cast("int"), F.least(n, F.ceil(end * fps)).cast("int")


def ratio_axis(tw: Column, th: Column) -> Column:
    """The free axis as far as the target ratio alone tells: x for portrait, else y."""
    return F.when(th > tw, "x").otherwise("y")


def corners(x: Column, y: Column, w: Column, tw: Column, th: Column) -> Column:
    """A corner and a width as (x0, y0, x1, y1) of a box with ratio ``tw:th``."""
    return F.struct(x.alias("x0"), y.alias("y0"), (x + w).alias("x1"), (y + w * th / tw).alias("y1"))


def offset(center: Column, size: Column, crop: Column, alpha: Column | float = 1.0) -> Column:
    """Where a crop around a centre pulled to the middle by ``alpha`` starts, not rounded, held inside the frame."""
    return F.greatest(F.lit(0.0), F.least(shrink(center, alpha) * size - crop / 2, size - crop))


def centred(size: Column, crop: Column) -> dict[str, Column]:
    """The three roundings of a centred crop's start, by name."""
    return {"half_even": F.rint((size - crop) / 2).cast("int"), "floor": F.floor((size - crop) / 2).cast("int"), "offset": F.rint(offset(F.lit(0.5), size, crop)).cast("int")}


def truth_center(x: Column, y: Column, w: Column, size_w: Column, size_h: Column, tw: Column, th: Column, axis: Column) -> Column:
    """The centre of a true box on its free axis, as a share of the frame."""
    return F.when(axis == "x", (x + w / 2) / size_w).otherwise((y + w * th / tw / 2) / size_h)


def soft_shrink(center: Column, clutter: Column, k: float) -> Column:
    """A centre pulled to the middle the more, the more subjects there are."""
    return 0.5 + (center - 0.5) * F.exp(-clutter / k)


def pseudo_box(cx: Column, cy: Column, area: Column, w: Column, h: Column) -> Column:
    """A square of the given area around a centre, cut at the frame's edges, in pixels."""
    half = F.sqrt(F.greatest(area, F.lit(0.0))) / 2
    return F.struct((F.greatest(cx - half, F.lit(0.0)) * w).alias("x0"), (F.greatest(cy - half, F.lit(0.0)) * h).alias("y0"), (F.least(cx + half, F.lit(1.0)) * w).alias("x1"), (F.least(cy + half, F.lit(1.0)) * h).alias("y1"))


def normalised(x0: Column, y0: Column, x1: Column, y1: Column, w: Column, h: Column) -> Column:
    """Corners in pixels as centre (5 places) and area (6 places), shares of the frame, rounded half to even."""
    even = lambda v, scale: F.rint(v * scale) / scale
    return F.struct(even((x0 + x1) / 2 / w, 1e5).alias("cx"), even((y0 + y1) / 2 / h, 1e5).alias("cy"), even((x1 - x0) * (y1 - y0) / (w * h), 1e6).alias("area"))


def frames_of_segment(start: Column, end: Column, fps: Column, n: Column) -> Column:
    """Seconds as a closed range of frames, rounded and clamped; null where nothing is left. The ends may come in either order."""
    at = lambda s: F.greatest(F.lit(0), F.least(F.rint(s * fps).cast("int"), n - 1))
    a, b = at(F.least(start, end)), at(F.greatest(start, end))
    return F.when(b > a, F.struct(a.alias("start"), b.alias("end")))


def frames_of_share(start: Column, end: Column, duration: Column, n: Column) -> Column:
    """Seconds of a clip as a half-open range of its counted frames, one frame at least."""
    a = F.greatest(F.lit(0), F.least(n - 1, F.floor(start / duration * n).cast("int")))
    return F.struct(a.alias("start"), F.greatest(a + 1, F.least(n, F.ceil(end / duration * n).cast("int"))).alias("end"))


def widen(start: Column, end: Column, factor: float, lo: Column, hi: Column) -> Column:
    """An interval made wider (or narrower) about its centre, clamped to ``lo`` .. ``hi``."""
    middle, half = (start + end) / 2, (end - start) / 2 * factor
    return F.struct(F.greatest(lo, middle - half).alias("start"), F.least(hi, middle + half).alias("end"))


def keep_ratio(start: Column, end: Column, n: Column, least: float, most: float) -> Column:
    """A half-open range of frames grown or cut on both sides, so that its share of ``n`` lies between ``least`` and ``most`` where the clip allows it."""
    lo, hi, length = F.floor(n * least).cast("int"), F.floor(n * most).cast("int"), end - start
    grow, drop = lo - length, length - hi
    short, long = (lo > 0) & (length < lo), (hi > 0) & (length > hi)
    half = lambda x: F.floor(x / 2).cast("int")
    a = F.when(short, F.greatest(F.lit(0), start - half(grow))).when(long, start + half(drop)).otherwise(start)
    b = F.when(short, F.least(n, end + grow - half(grow))).when(long, end - (drop - half(drop))).otherwise(end)
    return F.struct(F.greatest(F.lit(0), F.least(n - 1, a)).alias("start"), F.greatest(a + 1, F.least(n, b)).alias("end"))


def lerp(a: Column, b: Column, t: Column) -> Column:
    """Two arrays of numbers mixed place by place and rounded."""
    return F.zip_with(a, b, lambda x, y: F.rint(x + (y - x) * t).cast("int"))


def even_indices(n: Column, k: int) -> Column:
    """About ``k`` places spread evenly over 0 .. n - 1, both ends included; none for an empty clip."""
    if k < 2:
        return F.when(n > 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    places = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.rint(i * (n - 1) / (k - 1)).cast("int"))
    return F.when(n > 0, F.array_distinct(places)).otherwise(F.array().cast("array<int>"))


def kept_frames(n: Column, drop: float) -> Column:
    """How many frames of a clip stay where a share of its tail goes; one at least."""
    return F.greatest(F.lit(1), n - F.rint(n * drop)).cast("int")


def ceilings(mean_iou: Column, k: Column) -> dict[str, Column]:
    """The best F1 for a mean overlap where every true frame is predicted (``k`` predictions a true frame), and where predictions are a ``k``-th of the truth."""
    return {"all_found": 2 * mean_iou / (1 + k), "all_right": 2 * mean_iou * k / (1 + k)}


def unit_coordinate(v: Column, size: Column) -> Column:
    """A coordinate in 0..1 from a share, thousandths or pixels, guessed from its size."""
    share = F.when(v <= 1.5, v).when(v <= 1000, v / 1000).when(size > 0, v / size).otherwise(v / 1000)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))


def scale_of(values: Column) -> Column:
    """What an array of coordinates has to be divided by: 1, 100 or 1000, guessed from its largest number."""
    top = F.coalesce(F.array_max(F.transform(values, F.abs)), F.lit(0.0))
    return F.when(top <= 1.5, 1.0).when(top <= 150, 100.0).otherwise(1000.0)


def safe_ratio(pair: Column) -> Column:
    """The first two numbers of an array of texts as a ratio; 16:9 where one is missing or not positive."""
    tw, th = F.get(pair, F.lit(0)).try_cast("double"), F.get(pair, F.lit(1)).try_cast("double")
    good = (tw > 0) & (th > 0)
    return F.struct(F.when(good, tw).otherwise(16.0).alias("tw"), F.when(good, th).otherwise(9.0).alias("th"))
