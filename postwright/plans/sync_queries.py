"""Synchronisation queries: scans, joins, payload, upsert, ledger, cursor."""

from __future__ import annotations

from pyspark.sql import functions as F

from postwright.functions import language as L
from postwright.operators import sync as S
from postwright.operators import sync_run as SR
from postwright.plans.base import P, Registry, table
from postwright.sources import dims
from postwright.sources import schema as SC
from postwright.sources.postings import postings

R = Registry()
NOW = "1996-06-15 00:00:00"


def _now():
    return F.lit(NOW).cast("timestamp")


def _sources_sql() -> str:
    def text(x):
        return "NULL" if x is None else f"'{x}'"

    rows = ", ".join(f"({text(n)}, {text(c)}, {text(m)}, {text((g or {}).get('country_code_in_city'))}, {text((g or {}).get('region_in_city'))})" for n, c, m, g in dims.SOURCES)
    return f"s AS (SELECT * FROM (VALUES {rows}) AS v(db_name, country_code, currency, city_flag, region))"


@R.add(f"WITH {_sources_sql()} SELECT db_name, country_code, currency, coalesce(city_flag IN ('1', 'true', 'True'), false) AS country_in_city, region AS region_column FROM s")
def source_configs(spark, sf_dir):
    return dims.sources(spark).select("db_name", "country_code", "currency", dims.flag(F.col("config"), "country_code_in_city").alias("country_in_city"), dims.region_column(F.col("config")).alias("region_column"))


@R.add(f"WITH {_sources_sql()} SELECT db_name, currency FROM s WHERE db_name IN ('canada', 'uk', 'usa', 'nowhere') AND upper(trim(country_code)) IN ('CA', 'GB')")
def sync_source_filter(spark, sf_dir):
    code = L.fixed_length_code(F.col("country_code"), 2)
    return dims.sources(spark).filter(F.col("db_name").isin("canada", "uk", "usa", "nowhere") & code.isin("CA", "GB")).select("db_name", "currency")


def _tables(spark, sf_dir):
    """Source relations over the order tables: jobs, cities, sites, ledger."""
    orders, customers, suppliers = (table(spark, sf_dir, t) for t in ("orders", "customer", "supplier"))
    jobs = orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("city_id"), (F.col("o_orderkey") % 40).alias("site_id"), F.col("o_orderstatus").alias("status"), F.lower("o_orderpriority").alias("category"))
    cities = customers.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("region"), F.substring("c_name", -2, 2).alias("country_code"))
    sites = suppliers.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    ledger = table(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), F.when(F.col("event_id") % 3 == 0, "ai").otherwise("other").alias("destination"), (F.col("event_id") % 40).cast("smallint").alias("site_id"), F.col("ts").alias("dt"))
    return jobs, cities, sites, ledger


_FETCH = """WITH j AS (SELECT o_orderkey AS id, o_custkey AS city_id, o_orderkey % 40 AS site_id, o_orderstatus AS status, lower(o_orderpriority) AS category FROM orders),
g AS (SELECT event_id AS job_id FROM events WHERE event_id % 3 = 0)
SELECT id, city_id, site_id, status, CAST(NULL AS VARCHAR) AS salary_currency, category, c_name AS city_title, right(c_name, 2) AS city_country_code, c_mktsegment AS region_title, s_name AS site_title
FROM j LEFT JOIN customer ON c_custkey = city_id LEFT JOIN supplier ON s_suppkey = site_id"""


@R.add(f"{_FETCH} WHERE id > 100 AND NOT EXISTS (SELECT 1 FROM g WHERE g.job_id = id)")
def sync_fetch(spark, sf_dir):
    jobs, cities, sites, ledger = _tables(spark, sf_dir)
    return S.fetch(jobs, cities, sites, ledger, "ai", after=100, region_column="region")


@R.add(f"{_FETCH} WHERE id > 0")
def sync_resync(spark, sf_dir):
    jobs, cities, sites, _ = _tables(spark, sf_dir)
    return S.fetch(jobs, cities, sites, None, "ai", region_column="region")


@R.add("SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT event_id FROM events WHERE event_id % 3 = 0)")
def sync_anti_export(spark, sf_dir):
    jobs, _, _, ledger = _tables(spark, sf_dir)
    done = ledger.filter("destination = 'ai'").select(F.col("job_id").alias("id"))
    return jobs.select("id").join(done, "id", "left_anti")


@R.add("SELECT o_orderkey AS id FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 200")
def sync_keyset_page(spark, sf_dir):
    return S.keyset_page(_tables(spark, sf_dir)[0].select("id"), "id", 500, 200)


@R.add("SELECT o_orderkey AS id, c_custkey AS city, n_name AS region_title FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey")
def sync_region_join(spark, sf_dir):
    jobs, _, sites, _ = _tables(spark, sf_dir)
    cities = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.col("c_nationkey").alias("region_id"))
    regions = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("title"))
    return S.fetch(jobs, cities, sites, None, "ai", after=-1, regions=regions).select("id", F.col("city_id").alias("city"), "region_title")


@R.add(f"{P} SELECT source_job_id FROM p WHERE length(trim(country_code)) = 2")
def sync_skip_missing_country(spark, sf_dir):
    return S.with_country(postings(spark, sf_dir), "country_code").select("source_job_id")


_CODES = "upper(trim({0}))"
_PAYLOAD = f"""SELECT source_db, source_job_id, site_id, external_id, title, description, city_id, city_title,
  coalesce(CASE WHEN length(trim(country_code)) = 2 THEN upper(trim(country_code)) END, 'GB') AS country_code,
  coalesce(CASE WHEN length(trim(currency)) = 3 THEN upper(trim(currency)) END, 'GBP') AS salary_currency,
  CASE WHEN trim(category) <> '' THEN trim(category) END AS category, salary_min, published_at, expires_at,
  coalesce(contains(lower(subcategory), 'remote'), false) AS is_remote, coalesce(expires_at >= TIMESTAMP '{NOW}', true) AS is_active,
  CAST(NULL AS BIGINT) AS company_id, 'Co ' || city_id AS company_name, CAST(NULL AS VARCHAR) AS site_title, 'https://x.example/' || source_job_id AS url, CAST(NULL AS BIGINT) AS region_id, CAST(NULL AS VARCHAR) AS region_title,
  CAST(salary_min + 10 AS DECIMAL(15,2)) AS salary_max, CAST(NULL AS VARCHAR) AS salary_period, CASE WHEN source_job_id % 2 = 0 THEN 'full' END AS contract, CAST(NULL AS VARCHAR) AS experience, CAST(NULL AS VARCHAR) AS education FROM p"""


def _payload(spark, sf_dir):
    rows = postings(spark, sf_dir).withColumns({"company_name": F.concat(F.lit("Co "), F.col("city_id")), "url": F.concat(F.lit("https://x.example/"), F.col("source_job_id")), "salary_max": F.col("salary_min") + 10, "contract": F.when(F.col("source_job_id") % 2 == 0, "full")})
    return S.payload(rows, _now(), "GB", "GBP")


@R.add(f"{P} {_PAYLOAD}")
def sync_payload(spark, sf_dir):
    return _payload(spark, sf_dir).drop("language_code")


@R.add(f"{P} SELECT source_job_id, CASE WHEN length(trim(country_code)) = 2 THEN upper(trim(country_code)) END AS country, CASE WHEN length(trim(currency)) = 3 THEN upper(trim(currency)) END AS currency FROM p")
def country_currency_normalize(spark, sf_dir):
    return postings(spark, sf_dir).select("source_job_id", L.fixed_length_code(F.col("country_code"), 2).alias("country"), L.fixed_length_code(F.col("currency"), 3).alias("currency"))


@R.add(f"{P} SELECT source_job_id, coalesce(contains(lower(subcategory), 'remote'), false) AS is_remote, coalesce(expires_at >= TIMESTAMP '{NOW}', true) AS is_active FROM p")
def is_remote_active(spark, sf_dir):
    return postings(spark, sf_dir).select("source_job_id", L.is_remote(F.col("subcategory")).alias("is_remote"), L.is_active(F.col("expires_at"), _now()).alias("is_active"))


@R.add(f"{P} SELECT source_job_id FROM p WHERE coalesce(expires_at >= TIMESTAMP '{NOW}', true) AND (expires_at IS NULL OR expires_at > TIMESTAMP '{NOW}')")
def jobs_active_view(spark, sf_dir):
    return S.active(_payload(spark, sf_dir), _now()).select("source_job_id")


@R.add(f"{P} SELECT source_job_id FROM p WHERE source_job_id % 4 = 0 OR source_job_id % 6 = 0")
def normalise_backlog(spark, sf_dir):
    key = F.col("source_job_id")
    rows = postings(spark, sf_dir).select(key, F.when(key % 4 != 0, F.col("title")).alias("title_clean"), F.when(key % 6 != 0, F.col("title")).alias("description_clean"))
    return rows.filter(F.col("title_clean").isNull() | F.col("description_clean").isNull()).select("source_job_id")


def _snapshots(spark, sf_dir, older="source_job_id % 3 <> 1", newer="source_job_id % 2 = 1 OR source_job_id % 3 = 1"):
    """An older state of the fact table, and the new rows: together they hold every key, and some keys are in both."""
    rows = _payload(spark, sf_dir).select("source_db", "source_job_id", "site_id", "external_id", "title", "category")
    old = S.last_per_key(rows.filter(older), S.CONFLICT_KEY, "source_job_id")
    old = old.withColumns({"title": F.concat(F.lit("old "), F.col("title")), "email": F.lit("kept@x.example"), "external_id": F.when(F.col("source_job_id") % 10 == 0, F.concat(F.col("external_id"), F.lit("-moved"))).otherwise(F.col("external_id"))})
    new = rows.filter(newer).withColumn("category", F.when(F.col("source_job_id") % 9 != 0, F.col("category")))
    return old, new


_SNAP = f"""{P}, b AS (SELECT source_db, source_job_id, site_id, external_id, title, CASE WHEN trim(category) <> '' THEN trim(category) END AS category FROM p),
o1 AS (SELECT *, row_number() OVER (PARTITION BY source_db, site_id, external_id ORDER BY source_job_id DESC) AS r FROM b WHERE source_job_id % 3 <> 1),
o AS (SELECT source_db, source_job_id, site_id, CASE WHEN source_job_id % 10 = 0 THEN external_id || '-moved' ELSE external_id END AS external_id, 'old ' || title AS title, category, 'kept@x.example' AS email FROM o1 WHERE r = 1),
n1 AS (SELECT *, row_number() OVER (PARTITION BY source_db, site_id, external_id ORDER BY source_job_id DESC) AS r FROM b WHERE source_job_id % 2 = 1 OR source_job_id % 3 = 1),
n AS (SELECT source_db, source_job_id, site_id, external_id, title, CASE WHEN source_job_id % 9 <> 0 THEN category END AS category FROM n1 WHERE r = 1),
k AS (SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.source_db = o.source_db AND n.source_job_id = o.source_job_id AND (n.site_id <> o.site_id OR n.external_id <> o.external_id)))"""


@R.add(f"""{_SNAP} SELECT coalesce(n.source_db, k.source_db) AS source_db, coalesce(n.source_job_id, k.source_job_id) AS source_job_id, coalesce(n.site_id, k.site_id) AS site_id,
  coalesce(n.external_id, k.external_id) AS external_id, coalesce(n.title, k.title) AS title, coalesce(n.category, k.category) AS category, k.email AS email
  FROM k FULL JOIN n ON n.source_db = k.source_db AND n.site_id = k.site_id AND n.external_id = k.external_id""")
def sync_upsert(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    return S.upsert(old.select("source_db", "source_job_id", "site_id", "external_id", "title", "category", "email"), new)


@R.add("""WITH l AS (SELECT event_id % 500 AS job_id, CASE WHEN event_id % 3 = 0 THEN 'ai' ELSE 'other' END AS destination, ts AS dt FROM events)
SELECT job_id, destination, max(dt) AS dt FROM l GROUP BY 1, 2""")
def sync_ledger(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.col("event_id") % 500).alias("job_id"), F.when(F.col("event_id") % 3 == 0, "ai").otherwise("other").alias("destination"), F.col("ts").alias("dt"), "event_id")
    return S.record_exports(rows.filter("event_id % 2 = 0").drop("event_id"), rows.filter("event_id % 2 = 1").drop("event_id")).select("job_id", "destination", "dt")


@R.add(f"{P} SELECT source_db, max(source_job_id) AS last_job_id FROM p GROUP BY 1")
def sync_cursor(spark, sf_dir):
    return S.cursor(postings(spark, sf_dir))


@R.add(f"{P} SELECT source_db, count(*) AS fetched, count(*) FILTER (WHERE length(trim(country_code)) = 2) AS processed, count(*) FILTER (WHERE country_code IS NULL OR length(trim(country_code)) <> 2) AS skipped FROM p GROUP BY 1")
def sync_batch_totals(spark, sf_dir):
    usable = L.fixed_length_code(F.col("country_code"), 2).isNotNull()
    return S.totals(postings(spark, sf_dir), usable)


@R.add("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'xx' WHEN doc_id % 2 = 0 THEN lang END AS lang FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'filled' END FROM documents WHERE doc_id % 2 = 1")
def backfill_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "xx").when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("lang"))
    found = docs.filter("lang IS NULL").select("doc_id", F.when(F.col("doc_id") % 3 != 0, "filled").alias("lang"))
    return S.update_by_key(docs, found, "doc_id", ["lang"], overwrite=False)


def _opened(spark, sf_dir, name: str) -> SR.Source:
    """A source over the postings of one region; one of them cannot be opened, one lacks the city's country that it must have."""
    if name == "asia":
        raise OSError("no connection")
    rows = postings(spark, sf_dir).filter(F.col("source_db") == name)
    jobs = rows.select(F.col("source_job_id").alias("id"), "site_id", "external_id", F.col("title").alias("position"), "description", "city_id", "salary_min", F.col("currency").alias("salary_currency"), F.col("published_at").alias("published"), F.col("expires_at").alias("expires"), "subcategory", "category")
    cities = rows.groupBy(F.col("city_id").alias("id")).agg(F.max("city_title").alias("title"), F.max("country_code").alias("country_code"))
    sites = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    ledger = table(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), F.lit("ai").alias("destination")).filter("job_id % 3 = 0")
    return SR.Source(jobs, cities.drop("country_code") if name == "europe" else cities, sites, ledger, None, "GB", "GBP", {"country_code_in_city": "1", "currency_in_job": "1"})


@R.add(f"""{P}, g AS (SELECT event_id FROM events WHERE event_id % 3 = 0), c AS (SELECT source_db, city_id, max(country_code) AS code FROM p GROUP BY 1, 2),
f AS (SELECT p.source_db, source_job_id, length(trim(code)) = 2 AS usable FROM p JOIN c ON p.source_db = c.source_db AND p.city_id = c.city_id WHERE p.source_db NOT IN ('asia', 'europe') AND source_job_id > CASE p.source_db WHEN 'africa' THEN 1000 ELSE 0 END AND source_job_id NOT IN (SELECT event_id FROM g)),
t AS (SELECT source_db, count(*) AS fetched, count(*) FILTER (WHERE coalesce(usable, false)) AS processed, max(source_job_id) AS last_job_id FROM f GROUP BY 1)
SELECT source_db, fetched, processed, fetched - processed AS skipped, last_job_id, false AS failed FROM t UNION ALL SELECT r, 0, 0, 0, NULL, true FROM (VALUES ('asia'), ('europe')) AS v(r)
UNION ALL SELECT NULL, CAST(sum(fetched) AS BIGINT), CAST(sum(processed) AS BIGINT), CAST(sum(fetched - processed) AS BIGINT), NULL, false FROM t""")
def sync_run(spark, sf_dir):
    """A run over five sources, two of which fail: counts of each, and totals of the others."""
    names = ("africa", "america", "asia", "europe", "middle east")
    found = SR.run(spark, {n: (lambda n=n: _opened(spark, sf_dir, n)) for n in names}, {"africa": 1000}, "ai", _now(), lambda name, batch: None)
    return found.select("source_db", "fetched", "processed", "skipped", "last_job_id", F.col("error").isNotNull().alias("failed"))


@R.add("SELECT o_orderkey AS id, CAST(NULL AS BIGINT) AS source_job_id, 'x' AS source_db, CAST(o_custkey AS VARCHAR) AS title FROM orders")
def schema_conform(spark, sf_dir):
    """An older stored table under the declared schema: a renamed column, a column of another type, a missing and a dropped one."""
    old = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.lit("x").alias("db"), F.col("o_custkey").alias("title"), F.lit(1).alias("gone"))
    return SC.conform(old, SC.dims.JOBS, {"db": "source_db"}).select("id", "source_job_id", "source_db", "title")
