"""Application e-mail extraction and masking, all in Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postwright.functions import fixed_values as V
from postwright.functions.textops import SPANS, between, ci, located

_LOCAL = r"[a-zA-Z0-9._%+\-]"
#: The same language as V.EMAIL; tried once per run of local characters, so long texts stay linear.
EMAIL = V.EMAIL.replace(f"{_LOCAL}+@", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@")
EXCLUDED_LOCAL, STRONG_LOCAL = ci(V.EXCLUDED_LOCAL_PART), ci(V.STRONG_LOCAL_PART)
EXCLUDED_CONTEXT = ci(rf"\b({'|'.join(V.EXCLUDED_CONTEXT)})\b")
APPLY_CONTEXT = ci(rf"\b({'|'.join(V.APPLY_CONTEXT)})\b")


def emails(text: Column) -> Column:
    """All addresses with their places; texts without @ are not searched."""
    return F.when(F.contains(text, F.lit("@")), located(text, EMAIL)).otherwise(F.array().cast(SPANS))


def local_part(address: Column) -> Column:
    return F.substring_index(address, "@", 1)


def excluded_local(address: Column) -> Column:
    return local_part(address).rlike(EXCLUDED_LOCAL)


def strong_local(address: Column) -> Column:
    return local_part(address).rlike(STRONG_LOCAL)


def _window(text: Column, start: Column, end: Column) -> Column:
    return F.regexp_replace(between(text, start, end), EMAIL, "")


def look_back(text: Column, match: Column, chars: int) -> Column:
    """What stands before a match and the match itself, without any address."""
    return _window(text, match["start"] - chars, match["end"])


def context(text: Column, match: Column, chars: int = V.CONTEXT_CHARS) -> Column:
    return _window(text, match["start"] - chars, match["end"] + chars)


def accepted(text: Column, match: Column) -> Column:
    """Whether a match is an application address."""
    strong = strong_local(match["value"]) & ~look_back(text, match, V.STRONG_CONTEXT_CHARS).rlike(EXCLUDED_CONTEXT)
    near = ~look_back(text, match, V.CONTEXT_CHARS).rlike(EXCLUDED_CONTEXT) & context(text, match).rlike(APPLY_CONTEXT)
    return ~excluded_local(match["value"]) & (strong | near)


def application_email(text: Column) -> Column:
    """The first application address of a text, or null."""
    return F.get(F.filter(emails(text), lambda m: accepted(text, m)), 0)["value"]


def mask(text: Column, address: Column) -> Column:
    """All occurrences of an address replaced; the text as it is without one."""
    return F.when(address.isNull(), text).otherwise(F.replace(text, address, F.lit(V.EMAIL_MASK)))


def debug_context(text: Column, address: Column, chars: int = V.DEBUG_CHARS) -> Column:
    """The text around the first occurrence of an address."""
    at = F.instr(text, address) - 1
    return F.when(at >= 0, between(text, at - chars, at + F.length(address) + chars))
