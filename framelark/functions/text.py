"""Numbers and objects out of loose text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def last_numbers(text: Column, n: int = 2) -> Column:
    """The last ``n`` numbers in a text as doubles; null where there are fewer."""
    found = F.regexp_extract_all(text, F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0))
    return F.when(F.size(found) >= n, F.transform(F.slice(found, -n, n), lambda x: x.cast("double")))


def fraction(text: Column) -> Column:
    """``30000/1001`` or ``25`` as a double; null where it isn't one."""
    parts = F.split(text, "/")
    return F.when(F.size(parts) == 2, F.try_divide(parts[0].try_cast("double"), parts[1].try_cast("double"))).otherwise(text.try_cast("double"))


def summary(text: Column, most: int = 15) -> Column:
    """The first line without white space and outer quotes, cut to ``most`` characters."""
    line = F.regexp_replace(F.split_part(F.trim(text), F.lit("\n"), F.lit(1)), r"\s+", "")
    return F.substring(F.regexp_replace(line, "^[\"']+|[\"']+$", ""), 1, most)


def last_object(text: Column, keys: list[str]) -> Column:
    """Of the flat JSON objects in loose text, the last one with a number under one of ``keys``, as a map of strings; null where there is none."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"\{[^{}]*\}"), F.lit(0)), lambda o: F.from_json(o, "map<string,string>"))
    return F.try_element_at(F.filter(found, lambda m: aliased(m, keys).isNotNull()), F.lit(-1))


def aliased(values: Column, keys: list[str]) -> Column:
    """The first of ``keys`` under which a map of strings holds a number."""
    return F.coalesce(*(F.try_element_at(values, F.lit(k)).try_cast("double") for k in keys))


def base_name(path: Column) -> Column:
    """The last part of a path without its extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
