"""Deadline scanner: lines, rules in order, first date wins, open-ended values stop the scan.

The scan is one expression over a text, in its own row: no line leaves it, and nothing
is shuffled. Lines that no rule can fire on are passed by one combined pattern.
On the others the candidate strings are tried in the order of the rules, and parsing
ends with the first that gives a date or a stop; then so does the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postwright.functions import fixed_values as V
from postwright.functions.dates import month_first, open_ended, parse_date, partial_date
from postwright.functions.textops import ci, lines, strip

LABEL = ci(rf"(?s)(?:{'|'.join(V.DEADLINE_LABELS)})\s*:?\s*(.*)$")
START_LABEL = ci(rf"(?s)(?:{'|'.join(V.START_LABELS)})\s*:?\s*(.*)$")
APPLY_BY, RESUME_BY, SUBMIT_BY = ci(V.INLINE_APPLY_BY), ci(V.INLINE_RESUME_BY), ci(V.INLINE_SUBMIT_BY)
CLOSE_ON, ACCEPTED, BY, AU = ci(V.INLINE_CLOSE_ON), ci(V.INLINE_ACCEPTED_UNTIL), ci(V.BY_LINE), ci(V.AU_LINE)
BY_CONTEXT = ci(V.BY_LINE_CONTEXT)
#: Any line on which a rule can fire.
TRIGGERS = (*V.DEADLINE_LABELS, V.INLINE_APPLY_BY, V.INLINE_RESUME_BY, V.INLINE_SUBMIT_BY, V.INLINE_CLOSE_ON, V.INLINE_ACCEPTED_UNTIL, V.BY_LINE, V.AU_LINE)
FOUND = "struct<date:date,rule:string,open_ended:boolean>"


def _candidate(rank: int, rule: str, when: Column, text: Column, partial: bool = False, stops: bool = False) -> Column:
    made = F.struct(F.lit(rank).alias("rank"), text.alias("text"), F.lit(partial).alias("partial"), F.lit(stops).alias("stops"), F.lit(rule).alias("rule"))
    return F.when(when & text.isNotNull() & (text != ""), made)


def _join(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), " ")


def _rules(at: Column, all_lines: Column) -> Column:
    line = F.get(all_lines, at)
    nxt, after_next = F.get(all_lines, at + 1), F.get(all_lines, at + 2)
    before = F.slice(all_lines, F.greatest(at - 2, F.lit(1)), F.least(at, F.lit(3)))
    rest = lambda pattern: strip(F.regexp_extract(line, pattern, 1))
    label = line.rlike(LABEL)
    found = [
        _candidate(0, "label", label, rest(LABEL), True, True),
        _candidate(1, "label next line", label, nxt, True, True),
        _candidate(2, "label two lines", label & after_next.isNotNull(), F.concat_ws(" ", nxt, after_next), True),
    ]
    for rank, rule, pattern in ((10, "apply by", APPLY_BY), (20, "resume by", RESUME_BY), (30, "submit by", SUBMIT_BY)):
        hit = line.rlike(pattern)
        found += [_candidate(rank, rule, hit, rest(pattern)), _candidate(rank + 1, rule, hit & nxt.isNotNull(), F.concat_ws(" ", rest(pattern), nxt)), _candidate(rank + 2, rule, hit, nxt)]
    close = rest(CLOSE_ON)
    found.append(_candidate(40, "closes on", line.rlike(CLOSE_ON), F.when(close != "", close).otherwise(nxt)))
    following = [F.get(all_lines, at + k) for k in range(1, 5)]
    for k in range(1, 5):
        found.append(_candidate(49 + k, "accepted until", line.rlike(ACCEPTED), _join(rest(ACCEPTED), *following[:k])))
    by = line.rlike(BY) & F.array_join(before, " ").rlike(BY_CONTEXT)
    found += [_candidate(60, "by line", by, rest(BY), True), _candidate(61, "by line", by, nxt, True)]
    au = line.rlike(AU) & F.exists(before, lambda p: F.coalesce(p.rlike(r"\d"), F.lit(False)))
    found += [_candidate(70, "au line", au, rest(AU), True), _candidate(71, "au line", au, nxt, True)]
    return F.filter(F.array(*found), lambda c: c.isNotNull())


def _start_rules(at: Column, all_lines: Column) -> Column:
    line = F.get(all_lines, at)
    hit = line.rlike(START_LABEL)
    found = [_candidate(0, "start", hit, strip(F.regexp_extract(line, START_LABEL, 1))), _candidate(1, "start", hit, F.get(all_lines, at + 1))]
    return F.filter(F.array(*found), lambda c: c.isNotNull())


def _bind(value: Column, use) -> Column:
    """``use(value)``, with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _outcome(c: Column, at: Column, all_lines: Column, mdy: Column, as_of: Column) -> Column:
    """FOUND of a candidate, or null if it gives neither a date nor a stop."""
    before = F.slice(all_lines, F.greatest(at - 2, F.lit(1)), F.least(at, F.lit(3)))
    in_range = (c["rule"] != "au line") | F.exists(before, lambda p: parse_date(p, mdy).isNotNull())
    date = F.coalesce(parse_date(c["text"], mdy), F.when(c["partial"], partial_date(c["text"], as_of)))
    made = lambda d, stop: F.struct(d.alias("date"), c["rule"].alias("rule"), F.lit(stop).alias("open_ended"))
    stop = F.when(c["stops"] & open_ended(c["text"]), made(F.lit(None).cast("date"), True))
    return F.when(in_range, F.coalesce(stop, _bind(date, lambda d: F.when(d.isNotNull(), made(d, False)))))


def _scan(text: Column, as_of: Column, rules, triggers) -> Column:
    """FOUND of the first candidate of the first line that gives one; null without. ``triggers``: patterns of the lines that rules can fire on."""
    none, any_rule = F.lit(None).cast(FOUND), ci("|".join(f"(?:{x})" for x in triggers))

    def first(all_lines: Column, mdy: Column) -> Column:
        try_one = lambda a, c, at: F.when(a.isNotNull(), a).otherwise(_outcome(c, at, all_lines, mdy, as_of))
        line = lambda a, at: F.when(a.isNotNull(), a).otherwise(F.aggregate(rules(at, all_lines), none, lambda b, c: try_one(b, c, at)))
        hits = F.filter(F.transform(all_lines, lambda x, i: F.when(x.rlike(any_rule), i)), lambda i: i.isNotNull())
        return F.aggregate(hits, none, line)

    body = F.coalesce(text, F.lit(""))
    # a whole text is searched without the anchors of its lines
    return F.when(body.rlike(ci("|".join(f"(?:{x.lstrip('^')})" for x in triggers))), _bind(body, lambda t: _bind(F.struct(lines(t).alias("lines"), month_first(t).alias("mdy")), lambda b: first(b["lines"], b["mdy"]))))


def deadline(text: Column, as_of: Column) -> Column:
    """FOUND: the deadline of a text of lines, by which rule, or that it is open-ended; null without."""
    return _scan(text, as_of, _rules, TRIGGERS)


def start_date(text: Column, as_of: Column) -> Column:
    """The date after a text's first start label that gives one."""
    return _scan(text, as_of, _start_rules, V.START_LABELS)["date"]


def expiry_date(text: Column, as_of: Column) -> Column:
    """The deadline, or else the start date."""
    return F.coalesce(deadline(text, as_of)["date"], start_date(text, as_of))


def deadlines(docs: DataFrame, key: list[str], text: str, as_of: Column, only=None) -> DataFrame:
    """key, date, rule, open_ended of every document with a deadline or an open-ended label; ``only``: which candidates may give one."""
    rules = _rules if only is None else lambda at, all_lines: F.filter(_rules(at, all_lines), only)
    found = docs.select(*key, _scan(F.col(text), as_of, rules, TRIGGERS).alias("__d")).filter("__d IS NOT NULL")
    return found.select(*key, "__d.date", "__d.rule", "__d.open_ended")


def start_dates(docs: DataFrame, key: list[str], text: str, as_of: Column) -> DataFrame:
    """key, date of every document with a start date after its label."""
    return docs.select(*key, start_date(F.col(text), as_of).alias("date")).filter("date IS NOT NULL")


def expiry(docs: DataFrame, key: list[str], text: str, as_of: Column) -> DataFrame:
    """key, expiry_date: the deadline, or else the start date, of every document that has one."""
    return docs.select(*key, expiry_date(F.col(text), as_of).alias("expiry_date")).filter("expiry_date IS NOT NULL")
