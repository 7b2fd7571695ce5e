"""Regular expression matches with positions, and what is done with spans."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


MATCHES = "array<struct<start:int,end:int,value:string>>"
#: Elements of an array that are folded at a time: appending copies what there is so far, so a fold is kept short.
FOLDED = 64


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often and in whatever lambda it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def before_each(values: Column, zero: Column, merge: Callable[[Column, Column], Column], kind: str = "int") -> Column:
    """For each element what ``merge``, which is associative, makes of all elements before it.

    Parts of the array are folded one by one, then the parts' totals: n elements cost
    about n * FOLDED steps and the square of n / FOLDED, not the square of n.
    """

    def scan(own: Column, first: Column) -> Column:
        start = F.struct(first.alias("now"), F.array().cast(f"array<{kind}>").alias("out"))
        return F.aggregate(own, start, lambda s, x: F.struct(merge(s["now"], x).alias("now"), F.concat(s["out"], F.array(s["now"])).alias("out")), lambda s: s["out"])

    def in_parts(v: Column) -> Column:
        count = F.ceil(F.size(v) / FOLDED).cast("int")
        parts = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.slice(v, k * FOLDED + 1, FOLDED))
        return let(parts, lambda p: F.flatten(F.zip_with(p, scan(F.transform(p, lambda part: F.aggregate(part, zero, merge)), zero), scan)))

    return let(values, lambda v: F.when(F.size(v) <= FOLDED, scan(v, zero)).otherwise(in_parts(v)))


def find_all(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of the pattern's non-overlapping matches; start and end are code points.

    What stands between matches and the matches themselves, laid end to end, are the
    text: their lengths give the places. Patterns never match the empty string.
    """
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values"), F.split(text, pattern, -1).alias("between"))

    def pairs(m: Column) -> Column:
        return F.zip_with(F.slice(m["between"], F.lit(1), F.size(m["values"])), m["values"], lambda gap, value: F.struct(F.length(gap).alias("gap"), F.length(value).alias("size"), value.alias("value")))

    def placed(p: Column, at: Column) -> Column:
        return F.struct((at + p["gap"]).alias("start"), (at + p["gap"] + p["size"]).alias("end"), p["value"].alias("value"))

    def places(p: Column) -> Column:
        return F.zip_with(p, before_each(F.transform(p, lambda x: x["gap"] + x["size"]), F.lit(0), lambda a, b: a + b), placed)

    return F.when(text.rlike(pattern), let(let(found, pairs), places)).otherwise(F.array().cast(MATCHES))


def mask(text: Column, spans: Column, by: str = "*") -> Column:
    """The text with each span's characters replaced, its length unchanged; spans may overlap."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(F.greatest(s["start"], F.lit(0)).alias("start"), s["end"].alias("end"))))

    def pieces(b: Column) -> Column:
        def piece(s: Column, at: Column) -> Column:
            plain = F.array_join(F.slice(b["letters"], at + 1, F.greatest(s["start"] - at, F.lit(0))), "")
            hidden = F.greatest(F.least(s["end"], F.size(b["letters"])) - F.greatest(s["start"], at), F.lit(0))
            return F.concat(plain, F.repeat(F.lit(by), hidden))

        reached = before_each(F.transform(b["ordered"], lambda s: s["end"]), F.lit(0), lambda x, y: F.greatest(x, y))
        last = F.greatest(F.array_max(F.transform(b["ordered"], lambda s: s["end"])), F.lit(0))
        return F.concat(F.array_join(F.zip_with(b["ordered"], reached, piece), ""), F.array_join(F.slice(b["letters"], last + 1, F.size(b["letters"])), ""))

    whole = let(F.struct(F.split(text, "").alias("letters"), ordered.alias("ordered")), pieces)
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def span_text(text: Column, start: Column, end: Column) -> Column:
    """text[start:end]; an error for a negative start or an end before it."""
    return F.when((start < 0) | (end < start), F.raise_error(F.lit("bad span"))).otherwise(F.substring(text, start + 1, end - start))


def span_label(start: Column, end: Column) -> Column:
    return F.concat_ws("-", start.cast("string"), end.cast("string"))


def parse_span(label: Column) -> Column:
    """struct<start, end> of "start-end"."""
    return F.struct(F.split_part(label, F.lit("-"), F.lit(1)).cast("int").alias("start"), F.split_part(label, F.lit("-"), F.lit(2)).cast("int").alias("end"))


def occurrences(text: Column, needle: str) -> Column:
    """array<int>: all places of a fixed string, overlapping ones too."""
    if not needle:
        return F.when(text.isNotNull(), F.array().cast("array<int>"))
    parts = F.split(text, f"(?={re.escape(needle)})", -1)  # each begins at a place, but perhaps the first
    places = before_each(F.transform(parts, lambda x: F.length(x)), F.lit(0), lambda a, b: a + b)
    return F.filter(F.transform(places, lambda at, k: F.when((k > 0) | F.startswith(text, F.lit(needle)), at)), lambda at: at.isNotNull())
