"""Labelling, counts, splits, exports and quality reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from postwright.functions import email as E
from postwright.operators import deadline as DL
from postwright.operators import labelling as B
from postwright.operators import process as W
from postwright.operators import report as RP
from postwright.operators import sync as S
from postwright.plans import html_queries
from postwright.plans.base import P, Registry, table
from postwright.sources import dims
from postwright.sources.postings import postings

R = Registry()
SEED = "42"
_CATS = "cats AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(dims.CATEGORIES, 1)) + ") AS v(id, title))"
#: Mapping of source labels to categories, in another case than the rows'.
_LABELS = ("1-Urgent", "2-High", "3-Medium", "4-Not Specified")
_MAPPING = "map AS (SELECT * FROM (VALUES " + ", ".join(f"('{x}', {i + 3})" for i, x in enumerate(_LABELS)) + ") AS v(original_category, category_id))"


def _mapping(spark):
    return spark.createDataFrame([(x, i + 3) for i, x in enumerate(_LABELS)], "original_category string, category_id int")


#: The labelling store: documents with a quality label stand for labelled rows.
_STORE = f"st AS (SELECT doc_id AS id, 1 + doc_id % 21 AS category_id, quality = 1 AS verified FROM labels), {_CATS}"


def _store(spark, sf_dir):
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (1 + F.col("doc_id") % 21).alias("category_id"), (F.col("quality") == 1).alias("verified"))


@R.add(f"WITH {_CATS} SELECT * FROM cats")
def seed_categories(spark, sf_dir):
    return dims.categories(spark)


@R.add("WITH c AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{n}', {len(a or [])}, '{','.join(x)}')" for c, n, a, x in dims.COUNTRIES) + ") AS v(code, name, n_alternate, languages)) SELECT * FROM c")
def seed_countries(spark, sf_dir):
    return dims.countries(spark).select("code", "name", F.coalesce(F.array_size("alternate_names"), F.lit(0)).alias("n_alternate"), F.array_join("language_codes", ",").alias("languages"))


@R.add(f"{P}, {_MAPPING} SELECT source_job_id, category_id FROM p JOIN map ON lower(category) = lower(original_category)")
def category_map_inner(spark, sf_dir):
    return B.map_categories(postings(spark, sf_dir), _mapping(spark), "inner").select("source_job_id", "category_id")


@R.add(f"{P}, {_MAPPING} SELECT source_job_id, category_id FROM p LEFT JOIN map ON lower(category) = lower(original_category)")
def category_map_left(spark, sf_dir):
    return B.map_categories(postings(spark, sf_dir), _mapping(spark)).select("source_job_id", "category_id")


@R.add(f"WITH {_STORE} SELECT id, title, coalesce(n, 0) AS total, coalesce(v, 0) AS reviewed FROM cats LEFT JOIN (SELECT category_id, count(*) AS n, count(*) FILTER (WHERE verified) AS v FROM st GROUP BY 1) ON id = category_id")
def labelling_counts(spark, sf_dir):
    return B.review_counts(dims.categories(spark), _store(spark, sf_dir))


@R.add("SELECT toxic, count(*) AS n FROM labels GROUP BY toxic")
def grouped_count(spark, sf_dir):
    return table(spark, sf_dir, "labels").groupBy("toxic").agg(F.count("*").alias("n"))


@R.add("SELECT id, reviewed, row_number() OVER (ORDER BY reviewed NULLS FIRST, id) AS place FROM (SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE quality END AS reviewed FROM labels) ORDER BY 3 LIMIT 100")
def labelling_nulls_first(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 != 0, F.col("quality")).alias("reviewed"))
    top = rows.orderBy(F.asc_nulls_first("reviewed"), "id").limit(100)  # a page of the review list
    from pyspark.sql import Window

    return top.withColumn("place", F.row_number().over(Window.orderBy(F.asc_nulls_first("reviewed"), "id")).cast("long"))


@R.add("SELECT doc_id FROM documents WHERE lang IN ('en', 'fr') ORDER BY md5(concat_ws('|', doc_id, '42')), doc_id LIMIT 50")
def random_sample(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang").filter(F.col("lang").isin("en", "fr"))
    return docs.orderBy(B.seeded_order(F.col("doc_id"), SEED), "doc_id").limit(50).select("doc_id")


_QUOTA = f"""{P}, {_MAPPING}, mp AS (SELECT source_job_id AS k, category_id FROM p JOIN map ON lower(category) = lower(original_category)),
ex AS (SELECT k, category_id FROM mp WHERE k % 50 = 0), hv AS (SELECT category_id, count(*) AS have FROM ex GROUP BY 1),
he AS (SELECT source_job_id AS k, 3 + source_job_id % 6 AS category_id FROM p),
c1 AS (SELECT mp.k, mp.category_id, greatest(120 - coalesce(have, 0), 0) AS need FROM mp LEFT JOIN hv USING (category_id) WHERE mp.k NOT IN (SELECT k FROM ex)),
f1 AS (SELECT k, category_id FROM (SELECT *, row_number() OVER (PARTITION BY category_id ORDER BY md5(concat_ws('|', k, '42'))) AS r FROM c1) WHERE r <= floor(need * 80 / 100)),
t1 AS (SELECT category_id, count(*) AS taken FROM f1 GROUP BY 1),
c2 AS (SELECT he.k, he.category_id, greatest(120 - coalesce(have, 0), 0) - coalesce(taken, 0) AS need FROM he LEFT JOIN hv USING (category_id) LEFT JOIN t1 USING (category_id) WHERE he.k NOT IN (SELECT k FROM ex) AND he.k NOT IN (SELECT k FROM f1)),
f2 AS (SELECT k, category_id FROM (SELECT *, row_number() OVER (PARTITION BY category_id ORDER BY md5(concat_ws('|', k, '42'))) AS r FROM c2) WHERE r <= need)
SELECT k, category_id, 'map' AS pass FROM f1 UNION ALL SELECT k, category_id, 'heuristic' FROM f2"""


@R.add(_QUOTA)
def labelling_quota(spark, sf_dir):
    return _quota(spark, sf_dir)


def _quota(spark, sf_dir):
    rows = B.map_categories(postings(spark, sf_dir), _mapping(spark), "left").select(F.col("source_job_id").alias("k"), F.col("category_id").cast("long").alias("mapped"), (3 + F.col("source_job_id") % 6).alias("heuristic"))
    existing = rows.filter("k % 50 = 0 AND mapped IS NOT NULL").select("k", F.col("mapped").alias("category_id"))
    return B.quota_fill(rows, existing, 120, "k", SEED)


@R.add(_QUOTA.replace("SELECT k, category_id, 'map' AS pass FROM f1 UNION ALL SELECT k, category_id, 'heuristic' FROM f2", f"""z AS (SELECT k, category_id FROM f1 UNION ALL SELECT k, category_id FROM f2)
SELECT source_job_id, category_id, title, category AS original_category, {html_queries._FRAGMENT} AS description_clean, {html_queries._ADDRESS} AS email, {html_queries._EXPIRY} AS expiry_date FROM p JOIN z ON k = source_job_id""").replace("f2 AS (SELECT k, category_id FROM (SELECT *, row_number() OVER (PARTITION BY category_id ORDER BY md5(concat_ws('|', k, '42'))) AS r FROM c2) WHERE r <= need)", "f2 AS (SELECT k, category_id FROM (SELECT *, row_number() OVER (PARTITION BY category_id ORDER BY md5(concat_ws('|', k, '42'))) AS r FROM c2) WHERE r <= need),"))
def labelling_extraction(spark, sf_dir):
    """Rows chosen for labelling, cleaned, with the address and the date that the extractors find."""
    chosen = _quota(spark, sf_dir).select(F.col("k").alias("source_job_id"), "category_id")
    rows = html_queries._marked(spark, sf_dir).join(chosen, "source_job_id")
    return W.labelling_rows(rows, "source_job_id", html_queries._as_of()).drop("description")


@R.add(f"""WITH r AS (SELECT doc_id % 5 AS label, CASE WHEN doc_id % 11 > 0 THEN (doc_id * 7 + doc_id % 3) % 5 END AS predicted FROM documents) SELECT count(*) AS n, avg(CASE WHEN label = predicted THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS accuracy FROM r""")
def accuracy(spark, sf_dir):
    predicted = F.when(F.col("doc_id") % 11 > 0, (F.col("doc_id") * 7 + F.col("doc_id") % 3) % 5)
    return B.accuracy(table(spark, sf_dir, "documents").select((F.col("doc_id") % 5).alias("label"), predicted.alias("predicted")), "label", "predicted")


@R.add(f"WITH {_STORE} SELECT id, category_id, verified FROM st WHERE verified AND category_id = 4")
def labelling_verified(spark, sf_dir):
    return B.verified_only(_store(spark, sf_dir), True, 4)


@R.add("SELECT doc_id, toxic FROM labels WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, -1 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id % 2 = 0)")
def labelling_insert_absent(spark, sf_dir):
    have = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter("doc_id % 2 = 0")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.lit(-1).alias("toxic"))
    return S.insert_absent(have, rows.union(rows), "doc_id")


@R.add(f"WITH {_STORE} SELECT st.id, CASE WHEN st.id % 5 = 0 AND (st.id % 30) IN (SELECT id FROM cats) THEN st.id % 30 ELSE category_id END AS category_id, verified FROM st")
def label_update_valid(spark, sf_dir):
    store = _store(spark, sf_dir)
    return B.relabel(store, store.filter("id % 5 = 0").select("id", (F.col("id") % 30).alias("category_id")), dims.categories(spark))


@R.add(f"WITH {_STORE} SELECT id, category_id, CASE WHEN id % 7 = 0 THEN NOT verified ELSE verified END AS verified FROM st")
def labelling_toggle(spark, sf_dir):
    store = _store(spark, sf_dir)
    return B.toggle(store, store.filter("id % 7 = 0"))


@R.add(f"{P} SELECT source_job_id, false AS changed_email, false AS changed_expiry_date, {html_queries._MARKED_ADDRESS} IS NOT NULL AS changed_description_clean, {html_queries._MARKED_ADDRESS} IS NOT NULL AS would_update FROM p")
def dry_run_diff(spark, sf_dir):
    """What re-evaluation would change in every stored posting, as the difference of stored and recomputed columns, without a write."""
    rows = html_queries._marked(spark, sf_dir)
    done = W.process(rows.withColumn("full", F.lit(1)), "source_job_id", html_queries._as_of())
    stored = done.select("source_job_id", F.col("application_email").alias("email"), "expiry_date", "description_clean")
    found = W.reevaluate(rows, "source_job_id", html_queries._as_of()).drop("status")
    return B.would_change(stored, found, "source_job_id")


@R.add("SELECT '' AS title, coalesce(source, '') AS original_category, trim(regexp_replace(coalesce(text, ''), '<[^>]*>', ' ', 'g'), ' ') AS description_plaintext, 1 + doc_id % 21 AS category_id FROM documents")
def training_export(spark, sf_dir):
    """Every document with its whole text as the description; documents have no title, so it's blank."""
    none = F.lit(None).cast("string")
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (1 + F.col("doc_id") % 21).alias("category_id"), none.alias("title_clean"), none.alias("title"), F.col("source").alias("original_category"), F.col("text").alias("description_clean"))
    return B.training_rows(rows)


@R.add("""WITH s AS (SELECT lang, CAST(round(count(*) * 0.1) AS BIGINT) AS n FROM documents GROUP BY lang),
r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(concat_ws('|', doc_id, '42'))) AS r FROM documents) SELECT doc_id, lang, r <= n AS validation FROM r JOIN s USING (lang)""")
def stratified_split(spark, sf_dir):
    return B.stratified_split(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 0.1, SEED)


@R.add("""WITH r AS (SELECT doc_id % 5 AS label, (doc_id * 7 + doc_id % 3) % 5 AS predicted FROM documents),
a AS (SELECT label, count(*) AS support, count(*) FILTER (WHERE label = predicted) AS hits FROM r GROUP BY 1), b AS (SELECT predicted AS label, count(*) AS claimed FROM r GROUP BY 1),
c AS (SELECT label, coalesce(hits, 0)::DOUBLE / nullif(coalesce(claimed, 0), 0)::DOUBLE AS p, coalesce(hits, 0)::DOUBLE / nullif(coalesce(support, 0), 0)::DOUBLE AS r, coalesce(support, 0) AS support FROM a FULL JOIN b USING (label)),
d AS (SELECT label, coalesce(p, 0) AS p, coalesce(r, 0) AS r, support FROM c)
SELECT label, p AS precision, r AS recall, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0::DOUBLE END AS f1, CAST(support AS BIGINT) AS support FROM d""")
def confusion_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select((F.col("doc_id") % 5).alias("label"), ((F.col("doc_id") * 7 + F.col("doc_id") % 3) % 5).alias("predicted"))
    return B.classification_report(rows, "label", "predicted")


@R.add(f"""{P}, h AS (SELECT source_db, {html_queries._ADDRESS} IS NOT NULL AS e, {html_queries._EXPIRY} IS NOT NULL AND source_job_id % 16 <> 2 AS x, length(description) AS size FROM p)
SELECT source_db, count(*) AS n_rows, count(*) FILTER (WHERE e) AS n_email, round(count(*) FILTER (WHERE e)::DOUBLE / count(*), 6) AS share_email, count(*) FILTER (WHERE x) AS n_expiry, round(count(*) FILTER (WHERE x)::DOUBLE / count(*), 6) AS share_expiry,
  round(sum(size)::DOUBLE / count(*), 6) AS mean_chars FROM h GROUP BY source_db""")
def hit_rate_report(spark, sf_dir):
    """How often the extractors find an address and a date, source by source."""
    rows = postings(spark, sf_dir).withColumns({"email": E.application_email(F.col("description")), "expiry": DL.expiry_date(F.col("description"), html_queries._as_of())})
    return B.hit_rates(rows, ["source_db"], {"email": F.col("email").isNotNull(), "expiry": F.col("expiry").isNotNull()}, {"chars": F.length("description")})


_ESCAPED = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#x27;')"
_SHARE = "CAST(count(*) FILTER (WHERE {0}) AS VARCHAR) || ' (' || format('{{:.1f}}', 100 * count(*) FILTER (WHERE {0})::DOUBLE / greatest(count(*), 1)) || '%)'"


@R.add(f"""WITH s AS (SELECT CAST(NULL AS BIGINT) AS place, '<header>rows: ' || count(*) || ' · english: ' || {_SHARE.format("lang = 'en'")} || ' · long: ' || {_SHARE.format("length(text) > 1000")} || '</header>' AS page FROM documents),
t AS (SELECT doc_id, text, lang FROM documents ORDER BY doc_id LIMIT 50)
SELECT place, page FROM s UNION ALL SELECT doc_id, '<section><h2>doc: ' || doc_id || ' · lang: ' || {_ESCAPED.format("lang")} || '</h2><div class=''two''><pre>' || coalesce({_ESCAPED.format("text")}, '') || '</pre><div><p>x</p></div></div></section>' FROM t""")
def report_pages(spark, sf_dir):
    """A report over documents: a summary of all, and the first fifty."""
    docs = table(spark, sf_dir, "documents")
    return RP.report(docs, "doc_id", F.col("text"), F.lit("<p>x</p>"), {"doc": F.col("doc_id"), "lang": F.col("lang")}, {"english": F.col("lang") == "en", "long": F.length("text") > 1000}, 50)


#: Classes of a vector: the greatest of the components whose numbers leave the same remainder.
_PROBS = "e AS (SELECT vec_id, list_transform(range(22), lambda c: list_max(list_transform(list_filter(range(len(embedding)), lambda i: i % 22 = c), lambda i: abs(CAST(embedding[i + 1] AS DOUBLE))))) AS v FROM embeddings)"


@R.add(f"""WITH {_PROBS}, t AS (SELECT vec_id, v, list_max(v) AS top, list_position(v, list_max(v)) AS place FROM e),
o AS (SELECT *, list_transform(v, lambda x, i: CASE WHEN i = place THEN 0.0::DOUBLE ELSE x END) AS others FROM t)
SELECT vec_id, CASE WHEN place IN (1, 17) AND top < 2.5 THEN list_position(others, list_max(others)) ELSE place END AS category_id, CASE WHEN place IN (1, 17) AND top < 2.5 THEN list_max(others) ELSE top END AS confidence FROM o""")
def threshold_rerank(spark, sf_dir):
    group = lambda c: F.array_max(F.transform(F.filter("embedding", lambda x, i: i % 22 == c), lambda x: F.abs(x.cast("double"))))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.array(*[group(c) for c in range(22)]).alias("p"))
    return rows.select("vec_id", B.rerank(F.col("p"), {1: 2.5, 17: 2.5}).alias("r")).select("vec_id", "r.category_id", "r.confidence")
