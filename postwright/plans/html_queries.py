"""HTML and processing queries over ``pages`` and the postings view."""

from __future__ import annotations


from pyspark.sql import functions as F

from postwright.functions import email as E
from postwright.functions import language as L
from postwright.html import blocks
from postwright.html.blocks import ARTEFACTS
from postwright.html.udf import parsed
from postwright.operators import categorise as C
from postwright.operators import labelling as B
from postwright.operators import language_model as LM
from postwright.operators import process as W
from postwright.plans.base import P, Registry, table
from postwright.plans.html_cases import MARK_CASES, RULE_CASES, TEXT_CASES
from postwright.sources.dims import CATEGORIES, SOURCE_LABELS
from postwright.sources.postings import DESCRIPTIONS, postings
from postwright.sources.shared import dealt, stage

R = Registry()
AS_OF = "1996-06-15"
_ARTEFACT = rf"^({'|'.join(ARTEFACTS)})\s*$"


def _as_of():
    return F.lit(AS_OF).cast("date")


@R.add()
def html_clean_pages(spark, sf_dir):
    """Clean fragments of raw pages."""
    pages = table(spark, sf_dir, "pages").select("page_id", parsed(F.col("html")).alias("p"))
    return pages.select("page_id", F.col("p.html").alias("description_clean"), F.length("p.plain").alias("plain_chars"))


def _shipped(function, kind: str):
    """A function of the cleaner on a column of texts."""
    return F.pandas_udf(lambda texts: texts.map(function), kind)


_REPAIRED = r"""regexp_replace(url_decode(html), chr(194) || '[' || chr(128) || '-' || chr(159) || ']', '', 'g')"""
for _pattern, _new in ((r"""\\(["'/*])""", r"\1"), (r"(?s)!\*!<.*", ""), (r"\[\[.*?\]\]|\{\{.*?\}\}", ""), ('="http', '="\x01ttp'), (r"(https?://[^\s<>]+)", r'<a href="\1">\1</a>'), ("\x01", "h"), (r"\*\*([^*\n]+?)\*\*", r"<strong>\1</strong>")):
    _REPAIRED = f"regexp_replace({_REPAIRED}, '{_pattern.replace("'", "''")}', '{_new}', 'g')"


@R.add(f"SELECT page_id, {_REPAIRED} AS repaired FROM pages")
def html_text_stage(spark, sf_dir):
    """The cleaner's text stage on raw pages."""
    return table(spark, sf_dir, "pages").select("page_id", _shipped(blocks.repair, "string")("html").alias("repaired"))


_SPACED = "html"
for _pattern, _new in ((r"\n{3,}", "\n\n"), (r"[ \t]+", " "), (r"([^\s>])(<(?:strong|em|a)(?:\s[^>]*)?>)", r"\1 \2"), (r"(</(?:strong|em|a)>)([\pL\pN_])", r"\1 \2"), (r"(</(?:strong|em|a)>)(<(?:strong|em|a)(?:\s[^>]*)?>)", r"\1 \2")):
    _SPACED = f"regexp_replace({_SPACED}, '{_pattern}', '{_new}', 'g')"


@R.add(f"SELECT page_id, regexp_replace({_SPACED}, '^\\s+|\\s+$', '', 'g') AS spaced FROM pages")
def html_serialize_spacing(spark, sf_dir):
    """The cleaner's spacing of serialised fragments, on raw pages."""
    return table(spark, sf_dir, "pages").select("page_id", _shipped(blocks.space, "string")("html").alias("spaced"))


def _sql(text: str) -> str:
    """A text with § as SQL that puts the row's value there."""
    return " || w || ".join("'" + part.replace("'", "''") + "'" for part in text.split("§"))


def _put(text: str):
    """The same as a column."""
    return F.concat(*[x for i, part in enumerate(text.split("§")) for x in ([F.col("w")] if i else []) + [F.lit(part)]])


def _by_case(values: list[str], k: str = "k") -> str:
    return f"CASE {k} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def _items(spark, sf_dir, fragments: list[str], word=None):
    """Every part's key with the fragment that its number chooses."""
    k, word = F.col("p_partkey") % len(fragments), F.concat(F.lit("item"), F.col("p_partkey")) if word is None else word
    rows = table(spark, sf_dir, "part").select("p_partkey", k.alias("k"), word.alias("w"))
    choice = F.coalesce(*[F.when(F.col("k") == i, _put(x)) for i, x in enumerate(fragments)])
    return rows.select("p_partkey", parsed(choice).alias("p"))


_ITEMS = "i AS (SELECT p_partkey, p_partkey % {n} AS k, 'item' || p_partkey AS w FROM part)"


@R.add(f"WITH {_ITEMS.format(n=len(RULE_CASES))} SELECT p_partkey, {_by_case([_sql(clean) for _, clean in RULE_CASES.values()])} AS description_clean FROM i")
def html_rules(spark, sf_dir):
    """The whole cleaner on a fragment for each of its rules."""
    return _items(spark, sf_dir, [raw for raw, _ in RULE_CASES.values()]).select("p_partkey", F.col("p.html").alias("description_clean"))


@R.add(f"WITH {_ITEMS.format(n=len(TEXT_CASES))} SELECT p_partkey, {', '.join(f'{_by_case([_sql(c[j]) for c in TEXT_CASES])} AS {name}' for j, name in ((1, 'plain'), (2, 'spaced'), (3, 'raw_lines')))} FROM i")
def html_texts(spark, sf_dir):
    """The texts that later steps read from a page."""
    return _items(spark, sf_dir, [c[0] for c in TEXT_CASES]).select("p_partkey", "p.plain", "p.spaced", "p.raw_lines")


def _marks(case: tuple) -> str:
    return _sql("; ".join([f"{text} {'start' if start else 'end'}" for text, start in case[1]] + [f"{a} in {c}" for a, c in case[2]]))


@R.add(f"WITH i AS (SELECT p_partkey, p_partkey % {len(MARK_CASES)} AS k, CAST(1990 + p_partkey % 30 AS VARCHAR) AS w FROM part) SELECT p_partkey, {_by_case([_marks(c) for c in MARK_CASES])} AS marks FROM i")
def hl_marks(spark, sf_dir):
    """Marked dates and whether they are starts, marked addresses and their contexts."""
    found = _items(spark, sf_dir, [c[0] for c in MARK_CASES], (1990 + F.col("p_partkey") % 30).cast("string"))
    dates = F.transform("p.hl_dates", lambda d: F.concat(d["text"], F.when(d["is_start"], " start").otherwise(" end")))
    emails = F.transform("p.hl_emails", lambda e: F.concat(e["address"], F.lit(" in "), e["context"]))
    return found.select("p_partkey", F.array_join(F.concat(dates, emails), "; ").alias("marks"))


@R.add("WITH t AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Apply now' WHEN 1 THEN 'Job ID: ' || p_partkey WHEN 2 THEN p_name WHEN 3 THEN '-----' ELSE 'Search jobs for you' END AS t FROM part) SELECT p_partkey, regexp_matches(t, '" + _ARTEFACT.replace("'", "''") + "', 'i') AS artefact FROM t")
def ui_artifact_match(spark, sf_dir):
    k = F.col("p_partkey") % 5
    text = F.when(k == 0, "Apply now").when(k == 1, F.concat(F.lit("Job ID: "), F.col("p_partkey"))).when(k == 2, F.col("p_name")).when(k == 3, "-----").otherwise("Search jobs for you")
    return table(spark, sf_dir, "part").select("p_partkey", text.rlike(f"(?iU){_ARTEFACT}").alias("artefact"))


_HEADER_SQL = """length(t) BETWEEN 2 AND 80 AND len(string_split_regex(t, '\\s+')) <= 7 AND NOT regexp_matches(t, '[.?!]$') AND NOT contains(t, '@') AND NOT regexp_matches(t, '#\\d')
  AND NOT regexp_full_match(t, '[\\d\\s\\-+().x]{7,}') AND upper(t[1]) = t[1] AND NOT (contains(t, ',') AND len(string_split_regex(t, '\\s+')) <= 5) AND NOT regexp_full_match(t, '[\\d\\s\\-#./]+')"""


@R.add(f"WITH s AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN upper(p_name[1]) || p_name[2:] WHEN 1 THEN p_name WHEN 2 THEN 'Vancouver, BC' ELSE '#12 ' || p_name END AS t FROM part) SELECT p_partkey, {_HEADER_SQL} AS header FROM s")
def section_header_predicate(spark, sf_dir):
    k, name = F.col("p_partkey") % 4, F.col("p_name")
    t = F.when(k == 0, F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 1000))).when(k == 1, name).when(k == 2, "Vancouver, BC").otherwise(F.concat(F.lit("#12 "), name))
    return table(spark, sf_dir, "part").select("p_partkey", _shipped(blocks.section_header, "boolean")(t).alias("header"))


def _marked(spark, sf_dir):
    """Postings as HTML paragraphs, with marked dates and addresses."""
    marked = F.regexp_replace("description", f"({E.EMAIL})", '<span class="hl-email">$1</span>')
    marked = F.regexp_replace(marked, r"(\d{4}-\d{2}-\d{2})", '<span class="hl-date">$1</span>')
    body = F.concat(F.lit("<p>"), F.replace(marked, F.lit("\n"), F.lit("</p><p>")), F.lit("</p>"))
    return postings(spark, sf_dir).select("source_job_id", "title", body.alias("description"), F.col("category").alias("original_category"))


@R.add(f"""{P} SELECT source_job_id, len(regexp_extract_all(description, '\\d{{4}}-\\d{{2}}-\\d{{2}}')) AS n_dates, len(regexp_extract_all(description, '{E.V.EMAIL}')) AS n_emails FROM p""")
def hl_spans(spark, sf_dir):
    rows = _marked(spark, sf_dir).select("source_job_id", parsed(F.col("description")).alias("p"))
    return rows.select("source_job_id", F.size("p.hl_dates").cast("long").alias("n_dates"), F.size("p.hl_emails").cast("long").alias("n_emails"))


def _untagged(text):
    return F.regexp_replace(text, "<[^>]*>", " ")


def _languages(spark, sf_dir, rows, key="source_job_id"):
    """key, lang of every row: detected by the model of documents, and resolved; null where nothing is allowed."""
    blob = L.text_blob(F.col("title"), _untagged(F.col("description")))
    found = LM.detect(rows, key, blob, LM.fit(dealt(table(spark, sf_dir, "documents")))).withColumnRenamed("lang", "detected")
    none = F.lit(None).cast("string")
    return rows.select(key).join(found, key, "left").select(key, L.resolve(F.col("detected"), none, none).alias("lang"))


def _categoriser(spark, rows, key="source_job_id"):
    """Rows (key, title, text) -> (key, category), by a model of all rows whose source label the mapping knows.

    ``rows``: title, description, original_category, and n, the number of rows that each stands for, if it is there.
    """
    mapping = spark.createDataFrame([(x, i + 3) for i, x in enumerate(SOURCE_LABELS)], "original_category string, category_id int")
    known = B.map_categories(rows.withColumnRenamed("original_category", "category"), F.broadcast(mapping), "inner")
    text, weight = C.model_input(F.col("title"), _untagged(F.col("description"))), ["n"] if "n" in rows.columns else []
    model = C.fit(known.select(text.alias("input"), (F.col("category_id") - 1).cast("double").alias("label"), *weight), weight=weight[0] if weight else None)
    titles = F.array(*[F.lit(t) for t in CATEGORIES])

    def run(posts):
        found = C.predict(model, posts.select(key, C.model_input(F.col("title"), F.col("text")).alias("input")), [key])
        category = F.struct(F.col("category_id").cast("long").alias("id"), F.try_element_at(titles, F.col("category_id").cast("int")).alias("title"), F.col("confidence").cast("double").alias("confidence"))
        return found.select(key, category.alias("category"))

    return run


@R.add()
def process_full(spark, sf_dir):
    # every row, and each page (what the result depends on, but for the source's label) once: pages repeat in many postings
    rows = stage(dealt(_marked(spark, sf_dir).withColumn("full", F.lit(1)).withColumn("page", W.page_key("title", "description", "full"))), "postings")
    pages = stage(dealt(rows.select("page", "title", "description", "full").distinct()), "distinct-pages")
    labels = rows.groupBy("page", F.lower("original_category").alias("original_category")).agg(F.count("*").alias("n"))
    labelled = stage(pages.join(labels, "page"), "labelled-pages")
    return W.process(rows, "source_job_id", _as_of(), _languages(spark, sf_dir, pages, "page"), _categoriser(spark, labelled, "page"), None, pages)


_DAY = {
    **dict.fromkeys((0, 3, 4, 5, 6, 7, 8, 10), "CAST(strptime(regexp_extract(description, '([A-Z][a-z]+ \\d{1,2}, \\d{4})', 1), '%B %-d, %Y') AS DATE)"), 1: "CAST(strptime(regexp_extract(description, '\\d{2}/\\d{2}/\\d{4}'), '%d/%m/%Y') AS DATE)",
    **dict.fromkeys((2, 12), "CAST(regexp_extract(description, '\\d{4}-\\d{2}-\\d{2}') AS DATE)"), 9: "CAST(regexp_extract(description, 'au (\\S+)', 1) AS DATE)", 11: "DATE '1997-04-12'", 13: "NULL", 14: "DATE '1998-03-22'", 15: "DATE '1997-04-02'",
}
#: What each description of the postings view must give, by hand: its date, its address in the light mode (by its words) and in a re-evaluation (marked).
_EXPIRY = _by_case([_DAY[i] for i in range(len(DESCRIPTIONS))], f"source_job_id % {len(DESCRIPTIONS)}")
_ADDRESS = f"CASE source_job_id % {len(DESCRIPTIONS)} WHEN 0 THEN 'jane@acme.example' WHEN 1 THEN 'careers@acme.example' WHEN 13 THEN 'x@y.example' END"
_MARKED_ADDRESS = f"CASE WHEN source_job_id % {len(DESCRIPTIONS)} = 12 THEN 'office@acme.example' ELSE {_ADDRESS} END"
#: Paragraphs of the lines; a label without a value goes.
_FRAGMENT = "replace('<p>' || replace(description, chr(10), '</p><p>') || '</p>', '<p>We are accepting applications until:</p>', '')"
_HIDDEN = f"CASE WHEN {_ADDRESS} IS NOT NULL THEN replace({_FRAGMENT}, {_ADDRESS}, '***email_hidden***') ELSE {_FRAGMENT} END"


@R.add(f"{P} SELECT source_job_id, title AS title_normalized, {_HIDDEN} AS description_clean, {_ADDRESS} AS application_email, {_EXPIRY} AS expiry_date, CAST(NULL AS STRUCT(id BIGINT, title VARCHAR, confidence DOUBLE)) AS category, 'en' AS language_code FROM p")
def process_light(spark, sf_dir):
    rows = _marked(spark, sf_dir).withColumn("full", F.lit(0))
    return W.process(rows, "source_job_id", _as_of())


@R.add(f"{P} SELECT source_job_id, {_MARKED_ADDRESS} AS email, {_EXPIRY} AS expiry_date, CASE WHEN {_EXPIRY} < DATE '{AS_OF}' THEN 'expired' ELSE strftime({_EXPIRY}, '%Y-%m-%d') END AS status, {_FRAGMENT} AS description_clean FROM p")
def reevaluate_verified(spark, sf_dir):
    return W.reevaluate(_marked(spark, sf_dir), "source_job_id", _as_of())


@R.add(f"{P}, r AS (SELECT source_job_id, CASE source_job_id % 4 WHEN 0 THEN '   ' WHEN 1 THEN repeat('x', 600) ELSE ' ' || title || ' ' END AS title, CASE WHEN source_job_id % 7 = 0 THEN 2 ELSE 1 END AS f FROM p) SELECT source_job_id, trim(title) AS title FROM r WHERE length(trim(title)) BETWEEN 1 AND 512 AND f IN (0, 1)")
def request_validation(spark, sf_dir):
    k = F.col("source_job_id")
    title = F.when(k % 4 == 0, "   ").when(k % 4 == 1, F.repeat(F.lit("x"), 600)).otherwise(F.concat(F.lit(" "), F.col("title"), F.lit(" ")))
    rows = postings(spark, sf_dir).select(k, title.alias("title"), "description", F.when(k % 7 == 0, 2).otherwise(1).alias("full"))
    return W.validate(rows)[0].select("source_job_id", "title")


