"""Date parsing of posting texts as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postwright.functions import fixed_values as V
from postwright.functions.textops import ci, strip

OPEN = ci(V.OPEN_ENDED)


def _month(name: Column, *tables: dict[str, int]) -> Column:
    """Number of a month's name, by the first table that has it."""
    found = [F.try_element_at(F.create_map(*[F.lit(x) for pair in t.items() for x in pair]), F.lower(name)) for t in tables]
    return F.coalesce(*found)


def ymd(year: Column, month: Column, day: Column) -> Column:
    """A date of its parts; null where there is no such date."""
    given = [part.cast("string") for part in (month, day, year)]
    parts = [F.lpad(part, n, "0") for part, n in zip((given[2], given[0], given[1]), (4, 2, 2), strict=True)]
    # most texts lack most forms: what isn't there isn't parsed, as each failure to parse is an exception inside
    return F.when((given[0] != "") & (given[1] != "") & (given[2] != ""), F.try_to_date(F.concat_ws("-", *parts), "yyyy-MM-dd"))


def _groups(text: Column, pattern: str) -> tuple[Column, Column, Column]:
    return tuple(F.regexp_extract(text, pattern, i) for i in (1, 2, 3))


def iso_date(text: Column) -> Column:
    return ymd(*_groups(text, V.ISO))


def day_mon_date(text: Column) -> Column:
    d, m, y = _groups(text, V.DAY_MON)
    return ymd(y, _month(m, V.MONTH_ABBREVIATIONS), d)


def _either(a: Column, b: Column, year: Column, month_first: Column) -> Column:
    m_d, d_m = ymd(year, a, b), ymd(year, b, a)
    return F.when(month_first, F.coalesce(m_d, d_m)).otherwise(F.coalesce(d_m, m_d))


def numeric_date(text: Column, month_first: Column) -> Column:
    """D/M/Y or M/D/Y; years of two digits only where none has four."""
    a, b, y = _groups(text, V.NUMERIC)
    c, d, yy = _groups(text, V.SHORT_NUMERIC)
    short = F.when(yy != "", _either(c, d, F.concat(F.lit("20"), yy), month_first))
    return F.when(y != "", _either(a, b, y, month_first)).otherwise(short)


def ordinal_date(text: Column) -> Column:
    d, m, y = _groups(text, V.ORDINAL)
    return ymd(y, _month(m, V.EN_MONTHS), d)


def day_month_date(text: Column) -> Column:
    d, m, y = _groups(text, V.DAY_MONTH)
    return ymd(y, _month(m, V.FR_MONTHS, V.EN_MONTHS), d)


def month_day_date(text: Column) -> Column:
    m, d, y = _groups(text, V.MONTH_DAY)
    return ymd(y, _month(m, V.EN_MONTHS), d)


def open_ended(text: Column) -> Column:
    return text.rlike(OPEN)


def parse_date(text: Column, month_first: Column | bool = False) -> Column:
    """The first form that gives a date; null for open-ended values."""
    month_first = F.lit(month_first) if isinstance(month_first, bool) else month_first
    forms = [iso_date(text), day_mon_date(text), numeric_date(text, month_first), ordinal_date(text), day_month_date(text), month_day_date(text)]
    return F.when(~open_ended(text) & (strip(text) != ""), F.coalesce(*forms))


def partial_date(text: Column, as_of: Column) -> Column:
    """Month and day without a year: the first such day from ``as_of`` on, this year or next."""
    month, day = _month(F.regexp_extract(text, V.PARTIAL, 1), V.EN_MONTHS), F.regexp_extract(text, V.PARTIAL, 2)
    this, following = ymd(F.year(as_of), month, day), ymd(F.year(as_of) + 1, month, day)
    return F.when(~text.rlike(r"\d{4}"), F.coalesce(F.when(this >= as_of, this), F.when(following >= as_of, following)))


def month_first(text: Column) -> Column:
    """Whether a text's numeric dates put the month first: by the first one that tells."""
    parts = F.arrays_zip(F.regexp_extract_all(text, F.lit(V.NUMERIC), F.lit(1)).alias("a"), F.regexp_extract_all(text, F.lit(V.NUMERIC), F.lit(2)).alias("b"))
    telling = F.filter(parts, lambda p: (p["a"].cast("int") > 12) | (p["b"].cast("int") > 12))
    return F.coalesce(F.get(telling, 0)["b"].cast("int") > 12, F.lit(False))


def expiry_status(date: Column, as_of: Column) -> Column:
    """``expired`` for a date before ``as_of``, the date itself as text for another, null without one."""
    return F.when(date < as_of, "expired").otherwise(F.date_format(date, "yyyy-MM-dd"))
