"""Title and language queries over the postings view."""

from __future__ import annotations

from pyspark.sql import functions as F

from postwright.functions import fixed_values as V
from postwright.functions import language as L
from postwright.functions import titles as T
from postwright.operators import categorise as C
from postwright.plans.base import P, Registry, table
from postwright.sources.postings import postings

R = Registry()


def _clean(t: str) -> str:
    edge = "[\\s\\-–—|,]+"
    return f"regexp_replace(regexp_replace({t}, '^{edge}|{edge}$', '', 'g'), '\\s+', ' ', 'g')"


def _strip_sql(t: str) -> str:
    """DuckDB pre-strip: RE2 has no lookahead, so the kept phrase is shielded first."""
    out = f"regexp_replace({t}, 'permanent(\\s+reliever)', 'p~rmanent\\1', 'gi')"
    for name, pattern in V.TITLE_STRIP:
        if name == "employment type":
            pattern = pattern.replace(r"\bpermanent(?!\s+reliever)\b", r"\bpermanent\b").replace(r"\btemp(?!\w)\b", r"\btemp\b").replace(r"perm(?!\w)", r"perm\b")
        out = _clean(f"regexp_replace({out}, '{pattern}', ' ', 'gi')")
    return f"replace(replace({out}, 'p~rmanent', 'permanent'), 'P~rmanent', 'Permanent')"


_L = V.SUFFIX_LETTERS
_THREE, _TWO = rf"\b({_L})\s*[/\-]\s*({_L})\s*[/\-]\s*({_L})\b", rf"\b({_L})\s*[/\-]\s*({_L})\b"


def _marker(t: str) -> str:
    g = lambda p, i: f"regexp_extract({t}, '{p}', {i})"
    return f"CASE WHEN regexp_matches({t}, '{_THREE}') THEN {g(_THREE, 1)} || '/' || {g(_THREE, 2)} || '/' || {g(_THREE, 3)} WHEN regexp_matches({t}, '{_TWO}') THEN {g(_TWO, 1)} || '/' || {g(_TWO, 2)} END"


# the shield writes its own capital: titles of the view that hold it start with "Permanent"
_S = _strip_sql("replace(title, 'Permanent Reliever', 'P~rmanent Reliever')")


@R.add(f"{P} SELECT source_job_id, {_S} AS stripped FROM p")
def title_pre_strip(spark, sf_dir):
    return postings(spark, sf_dir).select("source_job_id", T.pre_strip(F.col("title")).alias("stripped"))


@R.add(f"{P} SELECT source_job_id, {_clean("' - ' || title || ' |, '")} AS cleaned FROM p")
def title_separator_cleanup(spark, sf_dir):
    return postings(spark, sf_dir).select("source_job_id", T.clean_separators(F.concat(F.lit(" - "), F.col("title"), F.lit(" |, "))).alias("cleaned"))


@R.add(f"{P} SELECT source_job_id, {_marker('title')} AS marker FROM p")
def title_legal_suffix(spark, sf_dir):
    return postings(spark, sf_dir).select("source_job_id", T.legal_suffix(F.col("title")).alias("marker"))


@R.add(f"{P}, s AS (SELECT source_job_id, {_S} AS t, {_marker('title')} AS m FROM p) SELECT source_job_id, CASE WHEN m IS NOT NULL AND ({_marker('t')}) IS NULL THEN trim(t || ' ' || m) ELSE t END AS normalised FROM s")
def title_rules_only(spark, sf_dir):
    return postings(spark, sf_dir).select("source_job_id", T.normalise_by_rules(F.col("title")).alias("normalised"))


@R.add("""SELECT p_partkey, CASE WHEN lower(p_name) = p_name THEN array_to_string(list_transform(regexp_extract_all(p_name, '[\\pL]+|[^\\pL]+'), lambda x: upper(x[1]) || lower(x[2:])), '') ELSE p_name END AS cased,
  regexp_replace(trim(regexp_replace(regexp_replace(p_name, '\\s*[-–—]\\s*', ' - ', 'g'), '\\b(non)\\s+-\\s+([A-Za-z0-9]+)\\b', '\\1-\\2', 'gi')), '\\s+', ' ', 'g') AS spaced FROM part""")
def title_case_separators(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.fix_case(F.col("p_name")).alias("cased"), T.space_separators(F.col("p_name")).alias("spaced"))


@R.add(f"{P}, d AS (SELECT DISTINCT title FROM p), n AS (SELECT title, {_S} AS t FROM d) SELECT source_job_id, t AS stripped FROM p JOIN n USING (title)")
def title_memo(spark, sf_dir):
    """Distinct titles are normalised once and joined back: the memo of a per-row cache, set-based."""
    rows = postings(spark, sf_dir).select("source_job_id", "title")
    known = rows.select("title").distinct().select("title", T.pre_strip(F.col("title")).alias("stripped"))
    return rows.join(known, "title").select("source_job_id", "stripped")


@R.add(f"{P} SELECT source_job_id, trim(title) || chr(10) || substring(trim(description), 1, 1500) AS blob FROM p")
def lang_text_blob(spark, sf_dir):
    return postings(spark, sf_dir).select("source_job_id", L.text_blob(F.col("title"), F.col("description")).alias("blob"))


_BY_COUNTRY = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in L.BY_COUNTRY.items()) + "}"


@R.add(f"""{P}, c AS (SELECT source_job_id, source_db, upper(trim(coalesce(country_code, ''))) AS country, CASE source_job_id % 5 WHEN 0 THEN 'EN' WHEN 1 THEN 'el' WHEN 2 THEN 'xx' WHEN 3 THEN NULL ELSE 'fr' END AS det FROM p),
e AS (SELECT *, CASE WHEN lower(det) = 'el' THEN 'gr' ELSE lower(det) END AS code FROM c)
SELECT source_job_id, CASE WHEN code IN {L.ALLOWED} THEN code WHEN country NOT IN {L.MIXED_COUNTRIES} THEN CASE WHEN source_db = 'americas' THEN 'es' ELSE {_BY_COUNTRY}[country] END END AS language_code FROM e""")
def lang_fallback_chain(spark, sf_dir):
    key = F.col("source_job_id") % 5
    detected = F.when(key == 0, "EN").when(key == 1, "el").when(key == 2, "xx").when(key == 4, "fr")
    return postings(spark, sf_dir).select("source_job_id", L.resolve(detected, F.col("country_code"), F.col("source_db")).alias("language_code"))


#: Titles with references (§: the row's value) and what they mean, by hand.
_REFERENCES = [
    ("R&amp;D &#38; §", "R&D & §"), ("caf&eacute; §", "café §"), ("&#x20AC;§ &euro;", "€§ €"), ("a &lt b §", "a < b §"), ("&bogus; §", "&bogus; §"), ("&#128;§", "€§"), ("x &notit; §", "x ¬it; §"), ("&amp;amp; §", "&amp; §"), ("§ & co", "§ & co"),
]
#: Title, generated title, and the title that counts, by hand.
_GENERATED = [
    ("Cook - Full Time", "senior cook - lead", "Senior Cook - Lead"), ("Cook - Full Time", "", "Cook"), ("Full Time", "", "Full Time"), ("Techniker (m/w/d)", "Techniker", "Techniker m/w/d"), ("Cook", None, "Cook"),
    ("Non-Profit Lead", "Non-Profit Lead–Chief", "Non-Profit Lead - Chief"),
]


def _literal(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''").replace("§", "' || p_partkey || '") + "'"


def _choose(values: list[str | None], n: int) -> str:
    return f"CASE p_partkey % {n} " + " ".join(f"WHEN {i} THEN {_literal(v)}" for i, v in enumerate(values)) + " END"


def _chosen(values: list[str | None]):
    k = F.col("p_partkey") % len(values)
    return F.coalesce(*[F.when(k == i, F.replace(F.lit(v), F.lit("§"), F.col("p_partkey").cast("string"))) for i, v in enumerate(values) if v is not None])


@R.add(f"SELECT p_partkey, {_choose([b for _, b in _REFERENCES], len(_REFERENCES))} AS title FROM part")
def title_unescape(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.unescape(_chosen([a for a, _ in _REFERENCES])).alias("title"))


@R.add(f"SELECT p_partkey, {_choose([c for *_, c in _GENERATED], len(_GENERATED))} AS title FROM part")
def title_fallback(spark, sf_dir):
    """Generated titles, and what counts where a model gave none."""
    return table(spark, sf_dir, "part").select("p_partkey", T.normalise_with_fallback(_chosen([a for a, *_ in _GENERATED]), _chosen([b for _, b, _ in _GENERATED])).alias("title"))


@R.add(f"{P} SELECT source_job_id, title || ' ' || title || ' ' || title || ' ' || description AS input FROM p")
def categoriser_input(spark, sf_dir):
    return postings(spark, sf_dir).select("source_job_id", C.model_input(F.col("title"), F.col("description")).alias("input"))
