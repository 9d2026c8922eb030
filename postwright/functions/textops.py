"""Column helpers with the text semantics that the rules expect (Unicode classes, whole-text offsets)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<start:int,end:int,value:string>>"
LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1C-\x1E\u0085  ]"


def ci(pattern: str) -> str:
    """A pattern in Java's syntax: Unicode classes, case-insensitive."""
    return f"(?iU){pattern}"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def lines(text: Column) -> Column:
    """Stripped lines that are not blank, in order."""
    return F.filter(F.transform(F.split(text, LINE_BREAK, -1), strip), lambda x: x != "")


def located(text: Column, pattern: str) -> Column:
    """Matches as array<struct<start, end, value>> in code points: prefix sums over a split by the same pattern."""
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans"))

    def add(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["gap"])
        end = start + F.length(pair["value"])
        span = F.struct(start.alias("start"), end.alias("end"), pair["value"].alias("value"))
        return F.struct(end.alias("at"), F.array_append(acc["spans"], span).alias("spans"))

    return F.aggregate(F.filter(pairs, lambda p: p["value"].isNotNull()), zero, add, lambda acc: acc["spans"])


def between(text: Column, start: Column, end: Column) -> Column:
    """Code points from start (cut at 0) to end (exclusive)."""
    low = F.greatest(start, F.lit(0))
    return F.substring(text, low + 1, end - low)
