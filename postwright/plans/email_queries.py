"""E-mail queries over ``documents`` and the postings view."""

from __future__ import annotations

from pyspark.sql import functions as F

from postwright.functions import email as E
from postwright.functions import fixed_values as V
from postwright.operators.labelling import hit_rates
from postwright.plans.base import P, Registry, table
from postwright.sources.postings import postings

R = Registry()
_LOCAL_OUT, _LOCAL_IN = V.EXCLUDED_LOCAL_PART, V.STRONG_LOCAL_PART
_OUT, _IN = rf"(?i)\b({'|'.join(V.EXCLUDED_CONTEXT)})\b", rf"(?i)\b({'|'.join(V.APPLY_CONTEXT)})\b"


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


def _matches(source: str) -> str:
    """CTEs of all addresses with their places, by prefix sums over the texts between them."""
    return f"""
d AS ({source}), g AS (
  SELECT k, t, regexp_extract_all(t, '{V.EMAIL}') AS ms, string_split_regex(t, '{V.EMAIL}') AS gs FROM d WHERE contains(t, '@')
), m AS (
  SELECT k, t, i, ms[i] AS value, list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS s
  FROM (SELECT k, t, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM g)
), x AS (SELECT *, s + length(value) AS e, split_part(value, '@', 1) AS lp FROM m),
w AS (
  SELECT *, regexp_replace(substring(t, CAST(greatest(s - {V.STRONG_CONTEXT_CHARS}, 0) + 1 AS INT), CAST(e - greatest(s - {V.STRONG_CONTEXT_CHARS}, 0) AS INT)), '{V.EMAIL}', '', 'g') AS narrow,
    regexp_replace(substring(t, CAST(greatest(s - {V.CONTEXT_CHARS}, 0) + 1 AS INT), CAST(e - greatest(s - {V.CONTEXT_CHARS}, 0) AS INT)), '{V.EMAIL}', '', 'g') AS back,
    regexp_replace(substring(t, CAST(greatest(s - {V.CONTEXT_CHARS}, 0) + 1 AS INT), CAST(e + {V.CONTEXT_CHARS} - greatest(s - {V.CONTEXT_CHARS}, 0) AS INT)), '{V.EMAIL}', '', 'g') AS ctx
  FROM x
), a AS (
  SELECT k, i, value FROM w WHERE NOT regexp_matches(lp, '(?i){_q(_LOCAL_OUT)}') AND (
    (regexp_matches(lp, '(?i){_q(_LOCAL_IN)}') AND NOT regexp_matches(narrow, '{_q(_OUT)}')) OR (NOT regexp_matches(back, '{_q(_OUT)}') AND regexp_matches(ctx, '{_q(_IN)}')))
), f AS (SELECT k, arg_min(value, i) AS address FROM a GROUP BY k)"""


_DOCS = "SELECT doc_id AS k, text AS t FROM documents"
_POSTS = "SELECT source_job_id AS k, description AS t FROM p"


@R.add(f"WITH {_matches(_DOCS)} SELECT k AS doc_id, i - 1 AS nth, CAST(s AS INT) AS start, value AS address FROM x")
def email_matches(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(E.emails(F.col("text"))).alias("nth", "m"))
    return found.select("doc_id", F.col("nth").cast("long").alias("nth"), F.col("m.start").alias("start"), F.col("m.value").alias("address"))


@R.add(f"{P}, {_matches(_POSTS)} SELECT k AS source_job_id, address FROM f")
def email_extract(spark, sf_dir):
    found = postings(spark, sf_dir).select("source_job_id", E.application_email(F.col("description")).alias("address"))
    return found.filter("address IS NOT NULL")


@R.add(f"WITH {_matches(_DOCS)} SELECT k AS doc_id, address FROM f")
def email_extract_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", E.application_email(F.col("text")).alias("address")).filter("address IS NOT NULL")


@R.add(f"{P}, {_matches(_POSTS)} SELECT k AS source_job_id, value AS address, regexp_matches(lp, '(?i){_q(_LOCAL_OUT)}') AS excluded, regexp_matches(lp, '(?i){_q(_LOCAL_IN)}') AS strong FROM x WHERE i = 1")
def email_local_part(spark, sf_dir):
    first = postings(spark, sf_dir).select("source_job_id", F.get(E.emails(F.col("description")), 0)["value"].alias("address")).filter("address IS NOT NULL")
    return first.select("source_job_id", "address", E.excluded_local(F.col("address")).alias("excluded"), E.strong_local(F.col("address")).alias("strong"))


@R.add(f"{P}, {_matches(_POSTS)} SELECT k AS source_job_id, i - 1 AS nth, ctx AS context, regexp_matches(back, '{_q(_OUT)}') AS excluded, regexp_matches(ctx, '{_q(_IN)}') AS apply FROM w")
def email_context_window(spark, sf_dir):
    rows = postings(spark, sf_dir).select("source_job_id", "description", F.posexplode(E.emails(F.col("description"))).alias("nth", "m"))
    t, m = F.col("description"), F.col("m")
    ctx = E.context(t, m)
    return rows.select("source_job_id", F.col("nth").cast("long").alias("nth"), ctx.alias("context"), E.look_back(t, m, V.CONTEXT_CHARS).rlike(E.EXCLUDED_CONTEXT).alias("excluded"), ctx.rlike(E.APPLY_CONTEXT).alias("apply"))


@R.add(f"{P}, {_matches(_POSTS)} SELECT p.source_job_id, CASE WHEN address IS NULL THEN description ELSE replace(description, address, '{V.EMAIL_MASK}') END AS masked FROM p LEFT JOIN f ON k = source_job_id")
def email_mask(spark, sf_dir):
    rows = postings(spark, sf_dir)
    address = E.application_email(F.col("description"))
    return rows.withColumn("address", address).select("source_job_id", E.mask(F.col("description"), F.col("address")).alias("masked"))


@R.add(f"{P}, {_matches(_POSTS)} SELECT k AS source_job_id, substring(description, CAST(greatest(instr(description, address) - 1 - {V.DEBUG_CHARS}, 0) + 1 AS INT), CAST(instr(description, address) - 1 + length(address) + {V.DEBUG_CHARS} - greatest(instr(description, address) - 1 - {V.DEBUG_CHARS}, 0) AS INT)) AS around FROM f JOIN p ON k = source_job_id")
def email_debug_context(spark, sf_dir):
    rows = postings(spark, sf_dir).select("source_job_id", "description", E.application_email(F.col("description")).alias("address")).filter("address IS NOT NULL")
    return rows.select("source_job_id", E.debug_context(F.col("description"), F.col("address")).alias("around"))


@R.add(f"WITH {_matches(_DOCS)} SELECT lang, count(*) AS n_rows, count(address) AS n_email, round(CAST(count(address) AS DOUBLE) / count(*), 6) AS share_email FROM documents LEFT JOIN f ON k = doc_id GROUP BY lang")
def email_hit_rate_by_lang(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", E.application_email(F.col("text")).alias("address"))
    return hit_rates(docs, ["lang"], {"email": F.col("address").isNotNull()})


@R.add(f"""{P}, h AS (SELECT source_job_id, regexp_replace(description, '({V.EMAIL})', '<span class="hl-email">\\1</span>', 'g') AS t FROM p)
SELECT source_job_id, regexp_replace(t, '([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}})', '<span class="hl-date">\\1</span>', 'g') AS highlighted FROM h""")
def highlight_spans(spark, sf_dir):
    marked = F.regexp_replace("description", f"({E.EMAIL})", '<span class="hl-email">$1</span>')
    dated = F.regexp_replace(marked, r"([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})", '<span class="hl-date">$1</span>')
    return postings(spark, sf_dir).select("source_job_id", dated.alias("highlighted"))
