"""Date and deadline queries over the postings view and over date strings derived from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from postwright.functions import dates as D
from postwright.functions import fixed_values as V
from postwright.operators import deadline as DL
from postwright.plans.base import P, Registry, table
from postwright.sources.postings import postings

R = Registry()
#: Wall clock of the queries.
AS_OF = "1996-06-15"


def _as_of():
    return F.lit(AS_OF).cast("date")


def _map(table: dict[str, int]) -> str:
    return "MAP {" + ", ".join(f"'{k}': {v}" for k, v in table.items()) + "}"


def _ymd(y: str, m: str, d: str) -> str:
    return f"CAST(try_strptime(lpad({y}, 4, '0') || '-' || lpad(CAST({m} AS VARCHAR), 2, '0') || '-' || lpad({d}, 2, '0'), '%Y-%m-%d') AS DATE)"


def _g(t: str, pattern: str, i: int, flags: str = "i") -> str:
    return f"regexp_extract({t}, '{pattern}', {i}, '{flags}')"


def _month(name: str, *tables: dict[str, int]) -> str:
    return "coalesce(" + ", ".join(f"{_map(t)}[lower({name})]" for t in tables) + ", 0)"


_NUM, _SHORT = r"(\d{1,2})[/\-](\d{1,2})[/\-](\d{4})", r"(\d{1,2})[/\-](\d{1,2})[/\-](\d{2})\b"


def _either(a: str, b: str, y: str, mdy: str) -> str:
    x, z = _ymd(y, a, b), _ymd(y, b, a)
    return f"CASE WHEN {mdy} THEN coalesce({x}, {z}) ELSE coalesce({z}, {x}) END"


def forms(t: str, mdy: str = "false") -> dict[str, str]:
    """DuckDB expressions of the date forms, in order."""
    iso = _ymd(*[_g(t, V.ISO, i) for i in (1, 2, 3)])
    mon = _ymd(_g(t, V.DAY_MON, 3), _month(_g(t, V.DAY_MON, 2), V.MONTH_ABBREVIATIONS), _g(t, V.DAY_MON, 1))
    a, b, y = (_g(t, _NUM, i) for i in (1, 2, 3))
    c, d, yy = (_g(t, _SHORT, i) for i in (1, 2, 3))
    num = f"CASE WHEN {y} <> '' THEN {_either(a, b, y, mdy)} WHEN {yy} <> '' THEN {_either(c, d, f"('20' || {yy})", mdy)} END"
    o, f, e = r"(\d{1,2})(?:st|nd|rd|th)\s+([A-Za-z]+)\s+(\d{4})", r"(\d{1,2})\s+([a-zéûôàî]+)\s+(\d{4})", V.MONTH_DAY
    ordinal = _ymd(_g(t, o, 3), _month(_g(t, o, 2), V.EN_MONTHS), _g(t, o, 1))
    french = _ymd(_g(t, f, 3), _month(_g(t, f, 2), V.FR_MONTHS, V.EN_MONTHS), _g(t, f, 1))
    english = _ymd(_g(t, e, 3), _month(_g(t, e, 1), V.EN_MONTHS), _g(t, e, 2))
    return {"iso": iso, "mon": mon, "num": num, "ordinal": ordinal, "french": french, "english": english}


def parse(t: str, mdy: str = "false") -> str:
    return f"CASE WHEN NOT regexp_matches({t}, '{V.OPEN_ENDED}', 'i') AND trim({t}) <> '' THEN coalesce({', '.join(forms(t, mdy).values())}) END"


def _partial(t: str) -> str:
    p = r"\b([A-Za-z]+)\s+(\d{1,2})(?:st|nd|rd|th)?\b"
    m, d = _month(_g(t, p, 1), V.EN_MONTHS), _g(t, p, 2)
    this, following = (_ymd(f"'{int(AS_OF[:4]) + k}'", m, d) for k in (0, 1))
    return f"CASE WHEN NOT regexp_matches({t}, '\\d{{4}}') THEN coalesce(CASE WHEN {this} >= DATE '{AS_OF}' THEN {this} END, CASE WHEN {following} >= DATE '{AS_OF}' THEN {following} END) END"


#: Date strings of every form, one per order.
_FORMS = [
    ("%Y-%m-%d", "yyyy-MM-dd"), ("%d-%b-%Y", "dd-MMM-yyyy"), ("%d/%m/%Y", "dd/MM/yyyy"), ("%m/%d/%Y", "MM/dd/yyyy"), ("%-d-%-m-%y", "d-M-yy"), ("%B %-d, %Y", "MMMM d, yyyy"),
    ("%-d %B %Y", "d MMMM yyyy"), ("%b %d %Y", "MMM dd yyyy"), ("%B %-d", "MMMM d"),
]
_STRINGS_SQL = "s AS (SELECT o_orderkey, CASE o_orderkey % 9 " + " ".join(f"WHEN {i} THEN strftime(o_orderdate, '{f}')" for i, (f, _) in enumerate(_FORMS)) + " END AS t, o_orderkey % 2 = 0 AS mdy FROM orders)"


def _strings(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    chain = F.lit(None).cast("string")
    for i, (_, form) in enumerate(_FORMS):
        chain = F.when(F.col("o_orderkey") % 9 == i, F.date_format("o_orderdate", form)).otherwise(chain)
    return orders.select("o_orderkey", chain.alias("t"), (F.col("o_orderkey") % 2 == 0).alias("mdy"))


def _form_query(name: str, column, expression: str) -> None:
    @R.add(f"WITH {_STRINGS_SQL} SELECT o_orderkey, {expression} AS parsed FROM s", name=name)
    def query(spark, sf_dir):
        return _strings(spark, sf_dir).select("o_orderkey", column().alias("parsed"))


_f = forms("t", "mdy")
_form_query("date_iso", lambda: D.iso_date(F.col("t")), _f["iso"])
_form_query("date_dd_mon", lambda: D.day_mon_date(F.col("t")), _f["mon"])
_form_query("date_numeric", lambda: D.numeric_date(F.col("t"), F.col("mdy")), _f["num"])
_form_query("date_day_month", lambda: D.day_month_date(F.col("t")), _f["french"])
_form_query("date_month_day", lambda: D.month_day_date(F.col("t")), _f["english"])
_form_query("date_parse", lambda: D.parse_date(F.col("t"), F.col("mdy")), parse("t", "mdy"))
_form_query("date_partial_infer_year", lambda: D.partial_date(F.col("t"), _as_of()), _partial("t"))

_ORDINALS = "o AS (SELECT o_orderkey, CAST(day(o_orderdate) AS VARCHAR) || (CASE day(o_orderdate) % 4 WHEN 0 THEN 'th' WHEN 1 THEN 'st' WHEN 2 THEN 'nd' ELSE 'rd' END) || ' ' || strftime(o_orderdate, '%B %Y') AS t FROM orders)"


@R.add(f"WITH {_ORDINALS} SELECT o_orderkey, {forms('t')['ordinal']} AS parsed FROM o")
def date_ordinal(spark, sf_dir):
    day = F.day("o_orderdate")
    mark = F.when(day % 4 == 0, "th").when(day % 4 == 1, "st").when(day % 4 == 2, "nd").otherwise("rd")
    text = F.concat(day.cast("string"), mark, F.lit(" "), F.date_format("o_orderdate", "MMMM yyyy"))
    return table(spark, sf_dir, "orders").select("o_orderkey", D.ordinal_date(text).alias("parsed"))


_FRENCH = ", ".join(f"'{m}'" for m in V.FR_MONTHS)


@R.add(f"WITH f AS (SELECT o_orderkey, CAST(day(o_orderdate) AS VARCHAR) || ' ' || ([{_FRENCH}])[month(o_orderdate)] || ' ' || CAST(year(o_orderdate) AS VARCHAR) AS t FROM orders) SELECT o_orderkey, {parse('t')} AS parsed FROM f")
def date_fr_month(spark, sf_dir):
    month = F.get(F.array(*[F.lit(m) for m in V.FR_MONTHS]), F.month("o_orderdate") - 1)
    text = F.concat_ws(" ", F.day("o_orderdate").cast("string"), month, F.year("o_orderdate").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", D.parse_date(text).alias("parsed"))


@R.add(f"""{P}, m AS (SELECT source_job_id, list_filter(list_zip(regexp_extract_all(description, '{_NUM}', 1), regexp_extract_all(description, '{_NUM}', 2)),
  lambda x: CAST(x[1] AS INT) > 12 OR CAST(x[2] AS INT) > 12) AS telling FROM p)
SELECT source_job_id, coalesce(CAST(telling[1][2] AS INT) > 12, false) AS month_first FROM m""")
def mm_dd_detect(spark, sf_dir):
    return postings(spark, sf_dir).select("source_job_id", D.month_first(F.col("description")).alias("month_first"))


# --- the deadline scanner: rules are checked one by one against line tables --------------------
_LABELS = "|".join(V.DEADLINE_LABELS).replace("'", "''")
_LABEL = rf"(?:{_LABELS})\s*:?\s*(.*)$"
_LINES = f"""{P}, l0 AS (SELECT source_job_id AS k, list_filter(list_transform(string_split(description, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM p),
l AS (SELECT k, unnest(range(1, len(ls) + 1)) AS i, ls FROM l0), n AS (SELECT k, i, ls[i] AS line, ls[i + 1] AS nxt, ls[i + 2] AS after_next, list_filter(ls, lambda x, j: j < i AND j >= i - 3) AS before FROM l),
r AS (SELECT *, regexp_extract(line, '{_LABEL}', 1, 'is') AS after FROM n WHERE regexp_matches(line, '{_LABEL}', 'is'))"""


def _label_date(t: str) -> str:
    return f"coalesce({parse(t)}, {_partial(t)})"


@R.add(f"""{_LINES}, c AS (
  SELECT k, i, 0 AS rank, after AS t, true AS stops FROM r WHERE after <> '' UNION ALL SELECT k, i, 1, nxt, true FROM r WHERE nxt IS NOT NULL
  UNION ALL SELECT k, i, 2, nxt || ' ' || after_next, false FROM r WHERE after_next IS NOT NULL
), q AS (SELECT k, i * 10 + rank AS o, stops AND regexp_matches(t, '{V.OPEN_ENDED}', 'i') AS stop, {_label_date("t")} AS d FROM c), z AS (SELECT k, arg_min(struct_pack(d := d, stop := stop), o) AS x FROM q WHERE stop OR d IS NOT NULL GROUP BY k)
SELECT k AS source_job_id, x.d AS date, x.stop AS open_ended FROM z""")
def deadline_label(spark, sf_dir):
    found = DL.deadlines(postings(spark, sf_dir), ["source_job_id"], "description", _as_of(), only=lambda c: c["rank"] < 10)
    return found.select("source_job_id", "date", "open_ended")


@R.add(f"{_LINES} SELECT DISTINCT k AS source_job_id FROM r WHERE regexp_matches(after, '{V.OPEN_ENDED}', 'i') OR regexp_matches(nxt, '{V.OPEN_ENDED}', 'i')")
def deadline_open_ended_abort(spark, sf_dir):
    return DL.deadlines(postings(spark, sf_dir), ["source_job_id"], "description", _as_of()).filter("open_ended").select("source_job_id")


def _inline(name: str, rule: str, pattern: str, joined: bool = True) -> None:
    own = f"regexp_extract(line, '{pattern}', 1, 'i')"
    date = f"coalesce({parse(own)}, {parse(f"({own} || ' ' || coalesce(nxt, ''))")}, {parse('nxt')})" if joined else f"CASE WHEN {own} <> '' THEN {parse(own)} ELSE {parse('nxt')} END"

    @R.add(f"{_LINES}, h AS (SELECT k, i, {date} AS d FROM n WHERE regexp_matches(line, '{pattern}', 'i')) SELECT k AS source_job_id, arg_min(d, i) AS date FROM h WHERE d IS NOT NULL GROUP BY k", name=name)
    def query(spark, sf_dir):
        return DL.deadlines(postings(spark, sf_dir), ["source_job_id"], "description", _as_of(), only=lambda c: c["rule"] == rule).select("source_job_id", "date")


_inline("deadline_apply_by", "apply by", V.INLINE_APPLY_BY)
_inline("deadline_resume_by", "resume by", V.INLINE_RESUME_BY)
_inline("deadline_close_on", "closes on", V.INLINE_CLOSE_ON, joined=False)
_inline("deadline_accepted_until", "accepted until", V.INLINE_ACCEPTED_UNTIL)
# RE2 has no lookahead: words before "by" are those that aren't "by" itself
_inline("deadline_submit_by", "submit by", r"submit\w*\s+(?:(?:[^b\s]\S*|b[^y\s]\S*|b|by[^,\s]\S*)\s+){0,8}by\s*(.*)")


@R.add(f"""{_LINES}, h AS (SELECT k, i, regexp_extract(line, '{V.BY_LINE}', 1, 'i') AS t, nxt FROM n WHERE regexp_matches(line, '{V.BY_LINE}', 'i') AND regexp_matches(array_to_string(before, ' '), '{V.BY_LINE_CONTEXT}', 'i')),
q AS (SELECT k, i, coalesce({_label_date("t")}, {_label_date("nxt")}) AS d FROM h) SELECT k AS source_job_id, arg_min(d, i) AS date FROM q WHERE d IS NOT NULL GROUP BY k""")
def deadline_by_line(spark, sf_dir):
    return DL.deadlines(postings(spark, sf_dir), ["source_job_id"], "description", _as_of(), only=lambda c: c["rule"] == "by line").select("source_job_id", "date")


@R.add(f"""{_LINES}, h AS (SELECT k, i, regexp_extract(line, '{V.AU_LINE}', 1, 'i') AS t FROM n WHERE regexp_matches(line, '{V.AU_LINE}', 'i') AND len(list_filter(before, lambda x: {parse("x")} IS NOT NULL)) > 0),
q AS (SELECT k, i, {parse("t")} AS d FROM h) SELECT k AS source_job_id, arg_min(d, i) AS date FROM q WHERE d IS NOT NULL GROUP BY k""")
def deadline_fr_range(spark, sf_dir):
    return DL.deadlines(postings(spark, sf_dir), ["source_job_id"], "description", _as_of(), only=lambda c: c["rule"] == "au line").select("source_job_id", "date")


_START = rf"(?:{'|'.join(V.START_LABELS)})\s*:?\s*(.*)$".replace("'", "''")


@R.add(f"""{_LINES}, h AS (SELECT k, i, regexp_extract(line, '{_START}', 1, 'is') AS t, nxt FROM n WHERE regexp_matches(line, '{_START}', 'is')),
q AS (SELECT k, i, coalesce({parse("t")}, {parse("nxt")}) AS d FROM h) SELECT k AS source_job_id, arg_min(d, i) AS date FROM q WHERE d IS NOT NULL GROUP BY k""")
def start_date_fallback(spark, sf_dir):
    return DL.start_dates(postings(spark, sf_dir), ["source_job_id"], "description", _as_of())


#: Rule of each description of the postings view, by hand; others have none. The third is open-ended.
_RULES = {0: "label", 1: "label", 2: "label", 3: "apply by", 4: "resume by", 5: "submit by", 6: "closes on", 7: "accepted until", 8: "by line", 9: "au line", 10: "label two lines", 11: "label", 14: "label", 15: "label"}
_DATES = {
    **dict.fromkeys((0, 3, 4, 5, 6, 7, 8, 10), r"CAST(strptime(regexp_extract(description, '([A-Z][a-z]+ \d{1,2}, \d{4})', 1), '%B %-d, %Y') AS DATE)"), 1: r"CAST(strptime(regexp_extract(description, '\d{2}/\d{2}/\d{4}'), '%d/%m/%Y') AS DATE)",
    9: r"CAST(regexp_extract(description, 'au (\S+)', 1) AS DATE)", 11: "DATE '1997-04-12'", 14: "DATE '1998-03-22'", 15: "DATE '1997-04-02'",
}


@R.add(f"""{P} SELECT source_job_id, CASE source_job_id % 16 {" ".join(f"WHEN {k} THEN {d}" for k, d in _DATES.items())} END AS date, CASE source_job_id % 16 {" ".join(f"WHEN {k} THEN '{r}'" for k, r in _RULES.items())} END AS rule, source_job_id % 16 = 2 AS open_ended
  FROM p WHERE source_job_id % 16 IN ({", ".join(map(str, _RULES))})""")
def deadline_scan(spark, sf_dir):
    """All rules together on the postings view."""
    return DL.deadlines(postings(spark, sf_dir), ["source_job_id"], "description", _as_of())


#: Texts in which several rules could fire, by hand: lines (A, B: two dates of the row), the date that counts and its rule.
_SEVERAL = [
    (["Please apply by A", "Deadline: B"], "A", "apply by"), (["Deadline: B", "Please apply by A"], "B", "label"), (["Deadline: apply by A"], "A", "label"),
    (["Closing date: see below", "Nothing here", "Please apply by A"], "A", "label two lines"), (["Closing date: see", "one", "two", "Please apply by A"], "A", "apply by"),
    (["Deadline: until filled", "Please apply by A"], None, "label"), (["Closing date:", "Open", "Deadline: A"], None, "label next line"), (["Send a resume by", "tomorrow", "A"], None, None),
    (["Applications are accepted until", "the day of", "or after", "A"], "A", "accepted until"), (["Please submit all papers by A", "by B"], "A", "submit by"), (["by A", "Deadline: B"], "B", "label"),
    (["Send your resume", "or call", "by A", "by B"], "A", "by line"), (["au A", "Fin: B"], None, None), (["Le B", "au A"], "A", "au line"), (["This job posting closes soon on", "A", "Deadline: B"], "A", "label next line"), (["This position will close soon on", "A", "Deadline: B"], "A", "closes on"),
]


def _several(n: int) -> str:
    day = lambda shift: f"strftime(CAST(o_orderdate AS DATE) + {shift}, '%Y-%m-%d')"
    return f"SELECT o_orderkey, o_orderkey % {n} AS k, {day(0)} AS a, {day(9)} AS b FROM orders"


@R.add(f"""WITH s AS ({_several(len(_SEVERAL))}) SELECT o_orderkey, CAST(CASE k {" ".join(f"WHEN {i} THEN {d.lower()}" for i, (_, d, _r) in enumerate(_SEVERAL) if d)} END AS DATE) AS date,
  CASE k {" ".join(f"WHEN {i} THEN '{r}'" for i, (_, _d, r) in enumerate(_SEVERAL) if r)} END AS rule, k IN ({", ".join(str(i) for i, (_, d, r) in enumerate(_SEVERAL) if r and not d)}) AS open_ended
  FROM s WHERE k IN ({", ".join(str(i) for i, (_, _d, r) in enumerate(_SEVERAL) if r)})""")
def deadline_precedence(spark, sf_dir):
    """Order of lines and rules, stops, and windows over several lines."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    a, b = F.date_format("day", "yyyy-MM-dd"), F.date_format(F.date_add("day", 9), "yyyy-MM-dd")
    text = F.coalesce(*[F.when(F.col("o_orderkey") % len(_SEVERAL) == i, F.lit("\n".join(x))) for i, (x, _, _) in enumerate(_SEVERAL)])
    text = F.regexp_replace(F.regexp_replace(text, r"\bA\b", F.lit("@")), r"\bB\b", F.lit("#"))
    rows = orders.select("o_orderkey", F.replace(F.replace(text, F.lit("@"), a), F.lit("#"), b).alias("t"))
    return DL.deadlines(rows, ["o_orderkey"], "t", _as_of())


@R.add(f"WITH {_STRINGS_SQL}, q AS (SELECT o_orderkey, {parse('t', 'mdy')} AS d FROM s) SELECT o_orderkey, CASE WHEN d < DATE '{AS_OF}' THEN 'expired' WHEN d IS NOT NULL THEN strftime(d, '%Y-%m-%d') END AS status FROM q")
def expiry_status(spark, sf_dir):
    rows = _strings(spark, sf_dir).select("o_orderkey", D.parse_date(F.col("t"), F.col("mdy")).alias("d"))
    return rows.select("o_orderkey", D.expiry_status(F.col("d"), _as_of()).alias("status"))
