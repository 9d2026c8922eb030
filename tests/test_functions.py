"""Hand-derived cases of the text rules, dates, titles, languages and e-mail extraction."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from postwright.functions import dates as D
from postwright.functions import email as E
from postwright.functions import language as L
from postwright.functions import titles as T
from postwright.operators import deadline as DL
from postwright.operators.labelling import rerank

AS_OF = "2026-03-01"


def column(spark, values, make, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r["y"] for r in rows.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def test_dates(spark):
    cases = {
        "March 19, 2026": "2026-03-19", "31/03/2026": "2026-03-31", "03/04/2026": "2026-04-03", "2 avril 2026": "2026-04-02", "16-MAR-2026": "2026-03-16",
        "22nd March 2026": "2026-03-22", "2026-02-31": "2031-02-26", "Ongoing": None, "until filled": None, "": None, "1er Août": None, "12/31/25": "2025-12-31", "7 août 2026": "2026-08-07",
    }
    got = column(spark, list(cases), D.parse_date)
    assert [d and d.isoformat() for d in got] == list(cases.values())


def test_partial_dates_and_order(spark):
    got = column(spark, ["April 12th", "February 3", "April 12 2026", "nothing"], lambda x: D.partial_date(x, F.lit(AS_OF).cast("date")))
    assert got == [dt.date(2026, 4, 12), dt.date(2027, 2, 3), None, None]
    assert column(spark, ["03/31/2026 then 31/03/2026", "31/03/2026 03/31/2026", "01/02/2026", "x"], D.month_first) == [True, False, False, False]


DEADLINES = {
    "Application Deadline: March 19, 2026": "2026-03-19", "Closing Date: 31/03/2026": "2026-03-31", "Closing Date: 03/04/2026": "2026-04-03",
    "starts 03/31/2026\nClosing Date: 03/04/2026": "2026-03-04", "Unposting Date: Ongoing\nDeadline: 2026-03-19": None, "Date limite pour postuler: 2 avril 2026": "2026-04-02",
    "Date limite: 2 avril 2026": None, "Closing: 16-MAR-2026": "2026-03-16", "deadline: 22nd March 2026": "2026-03-22", "accepted through April 12th": "2026-04-12",
    "Closing date\nFriday,\nMarch 6, 2026": "2026-03-06", "posting will close at 11:59 pm MST on March 16, 2026": "2026-03-16", "Du 2026-02-26\nau 2026-03-15": "2026-03-15",
    "au 2026-03-15": None, "Submit your CV\nby April 30, 2026": "2026-04-30", "by April 30, 2026": None, "Submit your application via our careers' website by 8 March 2026": "2026-03-08",
    "accepting applications until:\nMarch\n13,\n2026": "2026-03-13", "résumé by Wednesday,\nMarch 18, 2026": "2026-03-18", "Date de clôture : 2026-04-30": "2026-04-30", "plain text": None,
}


def test_deadlines(spark):
    docs = spark.createDataFrame(list(enumerate(DEADLINES)) + [(99, None)], "i int, t string")
    found = {r["i"]: r["date"] for r in DL.deadlines(docs, ["i"], "t", F.lit(AS_OF).cast("date")).collect()}
    assert {t: found[i].isoformat() if found.get(i) else None for i, t in enumerate(DEADLINES)} == DEADLINES


EMAILS = {
    "Send your resume to jane@acme.example": "jane@acme.example", "For accommodation contact recruitment@acme.example": None, "noreply@acme.example apply now": None,
    "careers@acme.example We are a disability services provider": "careers@acme.example", "apply: a@x.example or b@x.example": "a@x.example", "nothing@here.example": None,
    "privacy@x.example. Candidature: rh@y.example": "rh@y.example", "": None,
}


def test_application_email(spark):
    assert column(spark, list(EMAILS), E.application_email) == list(EMAILS.values())
    assert column(spark, ["a@b.co x a@b.co"], lambda x: E.mask(x, F.lit("a@b.co"))) == ["***email_hidden*** x ***email_hidden***"]


@pytest.mark.parametrize("text", ["a" * 20000 + " x", "a@" * 5000, "." * 20000 + "@"])
def test_long_texts_stay_linear(spark, text):
    assert column(spark, [text], E.application_email) == [None]


def test_titles(spark):
    cases = {
        "Software Engineer - Full Time": "Software Engineer", "Permanent Reliever": "Permanent Reliever", "Engineer #ABC123": "Engineer #ABC123", "Techniker (m/w/d)": "Techniker (m/w/d)",
        "Cook $18.50/hr | Part-time": "Cook", "Engineer #ENGR-123": "Engineer -123", "R&amp;D Lead": "R&D Lead", None: "", "Vendeur h/f CDI Casual": "Vendeur h/f CDI",
    }
    assert column(spark, list(cases), T.normalise_by_rules) == list(cases.values())
    assert column(spark, ["Techniker (m/w/d)", "Vendeur h/f", "x"], T.legal_suffix) == ["m/w/d", "h/f", None]
    assert column(spark, ["o'neil front-end", "Mixed case"], T.fix_case) == ["O'Neil Front-End", "Mixed case"]
    assert column(spark, ["a–b", "non - profit lead"], T.space_separators) == ["a - b", "non-profit lead"]


def test_language_chain(spark):
    rows = [("EN", None, None), ("el", "US", None), ("zz", "CA", "americas"), ("zz", "de", "americas"), (None, " fr ", "x"), (None, None, None)]
    df = spark.createDataFrame(rows, "d string, c string, s string")
    got = [r[0] for r in df.select(L.resolve(F.col("d"), F.col("c"), F.col("s"))).collect()]
    assert got == ["en", "gr", None, "es", "fr", None]


def test_rerank(spark):
    df = spark.createDataFrame([([0.45, 0.1, 0.15, 0.30],), ([0.6, 0.4, 0.0, 0.0],), ([0.1, 0.7, 0.2, 0.0],)], "p array<double>")
    got = [(r["r"]["category_id"], r["r"]["confidence"]) for r in df.select(rerank(F.col("p"), {1: 0.5, 17: 0.5}).alias("r")).collect()]
    assert got == [(4, 0.30), (1, 0.6), (2, 0.7)]
