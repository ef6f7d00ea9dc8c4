"""Structured answers out of loose replies of models, as Column expressions over VARIANT.

JSON is read strictly, so ``NaN`` or a repeated key makes a candidate unreadable. Null or empty replies have no answer.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geometry

START = ("start_sec", "start", "begin_sec", "from_sec")
END = ("end_sec", "end", "stop_sec", "to_sec")
SUBJECT = ("subject", "subjects", "主体")
LISTS = ("points", "centers", "centres", "result", "results", "data")
BOXES = ("bbox_2d", "bbox")
X, Y = ("x", "cx", "center_x"), ("y", "cy", "center_y")

_SPACE = r"[\s\x0B\x1C-\x1F]"
_NUMBER = r"-?\d+\.?\d*"
#: An object that holds objects one level deep at most; possessive, so that long texts cost no recursion.
_SHALLOW = r"\{[^{}]*+(?:\{[^{}]*+\}[^{}]*+)*+\}"


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once and named, so that expressions that need it often stay small."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def is_list(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False))


def items(v: Column, path: str = "$") -> Column:
    """The elements of a list as an array of variants; null for anything else."""
    return _get(v, path, "array<variant>")


def number(v: Column) -> Column:
    """A number, a text that is one, or a truth value (1 or 0) as a double; else null."""
    return _get(v, "$", "double")


def first_number(v: Column, keys: tuple[str, ...]) -> Column:
    """The first of ``keys`` under which an object holds a number."""
    return F.coalesce(*(_get(v, f"$.{k}", "double") for k in keys))


def unfenced(text: Column) -> Column:
    """A reply without outer white space; of one that begins with a code fence, what stands inside, without the word json."""
    t = F.regexp_replace(text, f"^{_SPACE}+|{_SPACE}+$", "")
    inside = F.regexp_replace(F.get(F.split(t, "```"), F.lit(1)), f"^{_SPACE}*(?i:json)", "")
    return F.when(t.startswith("```"), inside).otherwise(t)


def _span(t: Column, opener: str, closer: str) -> tuple[Column, Column]:
    """Place of the first ``opener`` (0: none), and the text from there to the last ``closer``; null where there is none."""
    a, b = F.locate(opener, t), F.char_length(t) - F.locate(closer, F.reverse(t)) + 1
    found = (a > 0) & (F.locate(closer, t) > 0) & (b > a)
    return F.when(found, a).otherwise(0), F.when(found, F.substr(t, a, b - a + 1))


def _parsed(candidate: Column) -> Column:
    """JSON, if need be without commas before closing brackets."""
    return F.coalesce(F.try_parse_json(candidate), F.try_parse_json(F.replace(F.replace(candidate, F.lit(",]"), F.lit("]")), F.lit(",}"), F.lit("}"))))


def answer(text: Column) -> Column:
    """The first JSON object or array of a reply as a variant; the one that opens first is tried first. Null if neither can be read."""

    def choose(s: Column) -> Column:
        first = (s["at_list"] == 0) | ((s["at_object"] > 0) & (s["at_object"] < s["at_list"]))
        return F.when(first, F.coalesce(_parsed(s["object"]), _parsed(s["list"]))).otherwise(F.coalesce(_parsed(s["list"]), _parsed(s["object"])))

    def spans(t: Column) -> Column:
        (at_object, an_object), (at_list, a_list) = _span(t, "{", "}"), _span(t, "[", "]")
        return F.struct(at_object.alias("at_object"), an_object.alias("object"), at_list.alias("at_list"), a_list.alias("list"))

    return let(let(unfenced(text), spans), choose)


def interval(v: Column) -> Column:
    """(start, end, subject) of an answer, or of its first element if it is a list; the ends may come swapped. Null without two ends a thousandth apart."""

    def of(one: Column) -> Column:
        named = F.coalesce(*(F.nullif(_get(one, f"$['{k}']", "string"), F.lit("")) for k in SUBJECT), F.lit(""))
        return F.when(is_object(one), F.struct(first_number(one, START).alias("a"), first_number(one, END).alias("b"), named.alias("subject")))

    ends = let(let(v, lambda x: F.when(is_list(x), _get(x, "$[0]", "variant")).otherwise(x)), of)
    return let(ends, lambda e: F.when(F.abs(e["b"] - e["a"]) >= 1e-3, F.struct(F.least(e["a"], e["b"]).alias("start"), F.greatest(e["a"], e["b"]).alias("end"), e["subject"].alias("subject"))))


def segments(text: Column) -> Column:
    """Pairs of seconds of a reply as an array of (start, end).

    Of the objects in it that parse, the first one with pairs under ``segments``; if there is none, all pairs of numbers in square brackets
    behind the word segments. Elements that aren't pairs of numbers are left out. Empty if nothing is found, null for a null reply.
    """
    pair = lambda e: F.struct(_get(e, "$[0]", "double").alias("start"), _get(e, "$[1]", "double").alias("end"))
    whole = lambda s: s["start"].isNotNull() & s["end"].isNotNull()
    objects = F.transform(F.regexp_extract_all(text, F.lit(_SHALLOW), F.lit(0)), F.try_parse_json)
    pairs = F.transform(objects, lambda o: F.filter(F.transform(F.coalesce(items(o, "$.segments"), F.array().cast("array<variant>")), pair), whole))
    told = F.get(F.filter(pairs, lambda p: F.size(p) > 0), F.lit(0))
    at = F.locate("segments", text)
    tail = F.when(at > 0, F.substr(text, at)).otherwise("")
    loose = lambda g: F.regexp_extract_all(tail, F.lit(rf"\[\s*({_NUMBER})\s*,\s*({_NUMBER})\s*\]"), F.lit(g))
    found = F.zip_with(loose(1), loose(2), lambda a, b: F.struct(a.cast("double").alias("start"), b.cast("double").alias("end")))
    return F.when(text.isNotNull(), F.coalesce(told, found))


def _corner_mean(values: Column) -> Column:
    """(x, y) of two numbers, of the last two of three, or the middle of a box of four; null for other sizes or with a null among them."""

    def of(vs: Column) -> Column:
        at = lambda i: F.get(vs, F.lit(i))
        p = F.when(F.size(vs) == 4, F.struct(((at(0) + at(2)) / 2).alias("x"), ((at(1) + at(3)) / 2).alias("y"))).when(F.size(vs) == 3, F.struct(at(1).alias("x"), at(2).alias("y"))).when(F.size(vs) == 2, F.struct(at(0).alias("x"), at(1).alias("y")))
        return F.when(~F.exists(vs, lambda v: v.isNull()), p)

    return let(values, of)


def point(e: Column) -> Column:
    """One element as (x, y), not scaled: two numbers, an index and two, a box of four, an object with x and y or with a box. Null for anything else."""
    boxed = reduce(lambda a, b: a | b, (_get(e, f"$.{k}", "variant").isNotNull() for k in BOXES))
    values = F.coalesce(*(items(e, f"$.{k}") for k in BOXES))
    x, y = first_number(e, X), first_number(e, Y)
    pair = F.when(x.isNotNull() & y.isNotNull(), F.array(x, y))
    numbers = F.when(is_object(e), F.when(boxed, F.transform(values, number)).otherwise(pair)).when(is_list(e), F.transform(items(e), number))
    return _corner_mean(numbers)


def points(v: Column, most: int) -> Column:
    """Points of an answer as an array of (x, y) in 0..1.

    The list is the answer itself, the first list under one of some names, or a single object with a box or a coordinate; a list wrapped once more is
    opened. One scale (1, 100 or 1000) is guessed from the numbers of all its lists. Null if there is no list, it is empty or longer than ``most``, or one element is no point.
    """

    def listed(a: Column) -> Column:
        named = F.coalesce(*(items(a, f"$.{k}") for k in LISTS))
        bare = reduce(lambda x, y: x | y, (_get(a, f"$.{k}", "variant").isNotNull() for k in (*BOXES, *X)))
        return F.when(is_list(a), items(a)).when(is_object(a), F.coalesce(named, F.when(bare, F.array(a))))

    def opened(es: Column) -> Column:
        inner = let(_get(F.get(es, F.lit(0)), "$[0]", "variant"), lambda w: is_list(w) | is_object(w))
        return F.when((F.size(es) == 1) & inner, items(F.get(es, F.lit(0)))).otherwise(es)

    def scaled(es: Column) -> Column:
        flat = F.flatten(F.transform(es, lambda e: F.filter(F.transform(F.coalesce(items(e), F.array().cast("array<variant>")), number), lambda x: x.isNotNull())))
        return let(flat, lambda f: let(geometry.scale_of(f), lambda scale: let(F.transform(es, point), lambda ps: whole(ps, scale))))

    def whole(ps: Column, scale: Column) -> Column:
        unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c / scale))
        good = (F.size(ps) > 0) & (F.size(ps) <= most) & ~F.exists(ps, lambda p: p.isNull())
        return F.when(good, F.transform(ps, lambda p: F.struct(unit(p["x"]).alias("x"), unit(p["y"]).alias("y"))))

    return let(let(let(v, listed), opened), scaled)
