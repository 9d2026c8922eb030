"""Relational synchronisation: adaptive scans, joins, filters, payload, upsert, ledger and cursor, all set-based."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postwright.functions import language as L

#: Conflict key of the fact table, and the columns that an upsert leaves as they were.
CONFLICT_KEY, SOURCE_KEY = ("source_db", "site_id", "external_id"), ("source_db", "source_job_id")
KEPT_COLUMNS = ("id", "email", "title_clean", "description_clean", "embedding", "embedded_at")


def optional(df: DataFrame, name: str, kind: str) -> Column:
    """A column if the source has it, else a typed null under the same name."""
    return (F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name)


def fetch(jobs: DataFrame, cities: DataFrame, sites: DataFrame, ledger: DataFrame | None, destination: str, after: int = 0, regions: DataFrame | None = None, region_column: str | None = None) -> DataFrame:
    """New source rows: key range, ledger anti-join (none in a resync), left joins to city, region and site.

    The key range is a plain comparison that reaches the scan. Dimensions are
    joined by equality; whether one is small enough to broadcast is left to its measured size.
    """
    rows = jobs.filter(F.col("id") > after)
    rows = rows.select(*[c for c in rows.columns if c not in ("salary_currency", "category")], optional(jobs, "salary_currency", "string"), optional(jobs, "category", "string"))
    if ledger is not None:
        done = ledger.filter(F.col("destination") == destination).select(F.col("job_id").alias("id"))
        rows = rows.join(done, "id", "left_anti")
    city = [F.col("id").alias("city_id"), F.col("title").alias("city_title"), optional(cities, "country_code", "string").alias("city_country_code")]
    if region_column and region_column in cities.columns:
        city.append(F.col(region_column).alias("region_title"))
    elif regions is not None and "region_id" in cities.columns:
        city.append(F.col("region_id"))
    rows = rows.join(cities.select(*city), "city_id", "left")
    if regions is not None and "region_id" in rows.columns:
        rows = rows.join(regions.select(F.col("id").alias("region_id"), F.col("title").alias("region_title")), "region_id", "left")
    if "region_title" not in rows.columns:
        rows = rows.withColumn("region_title", F.lit(None).cast("string"))
    return rows.join(sites.select(F.col("id").alias("site_id"), F.col("name").alias("site_title")), "site_id", "left")


def with_country(rows: DataFrame, code: str = "city_country_code") -> DataFrame:
    """Rows whose city has a usable country code."""
    return rows.filter(L.fixed_length_code(F.col(code), 2).isNotNull())


def payload(rows: DataFrame, now: Column, default_country: str | None, default_currency: str | None, detected: Column | None = None) -> DataFrame:
    """The 28 target columns of source rows, derived ones included, in one projection; columns that a source lacks are null."""
    country = F.coalesce(L.fixed_length_code(F.col("country_code"), 2), F.lit(default_country))
    currency = F.coalesce(L.fixed_length_code(F.col("currency"), 3), F.lit(default_currency))
    own = lambda name, kind, source=None: optional(rows, source if source in rows.columns else name, kind).alias(name)
    label, expires = F.trim(own("category", "string")), own("expires_at", "timestamp", "expires")
    return rows.select(
        "source_db", "source_job_id", own("site_id", "smallint"), own("external_id", "string"), own("title", "string", "position"), own("description", "string"), own("company_id", "bigint"),
        own("company_name", "string"), own("site_title", "string"), own("url", "string"), own("city_id", "bigint"), own("city_title", "string"), own("region_id", "bigint"), own("region_title", "string"),
        country.alias("country_code"), L.resolve(detected if detected is not None else F.lit(None).cast("string"), country, F.col("source_db")).alias("language_code"),
        own("salary_min", "decimal(15,2)"), own("salary_max", "decimal(15,2)"), own("salary_period", "string"), currency.alias("salary_currency"), own("contract", "string"), own("experience", "string"),
        own("education", "string"), own("published_at", "timestamp", "published"), expires, L.is_remote(own("subcategory", "string")).alias("is_remote"), L.is_active(expires, now).alias("is_active"),
        F.when(label != "", label).alias("category"),
    )


def last_per_key(rows: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """Of rows that share a key, the one that comes last: partially aggregated, no sort."""
    rest = [c for c in rows.columns if c not in keys]
    last = F.max_by(F.struct(*[F.col(c) for c in rest]), F.col(order)).alias("__last")
    return rows.groupBy(*keys).agg(last).select(*keys, *[F.col(f"__last.{c}") for c in rest])


def upsert(current: DataFrame, new: DataFrame, order: str = "source_job_id") -> DataFrame:
    """The fact table after ``new``.

    Rows that hold a source id of ``new`` under another conflict key go; rows of the
    same conflict key take the new values but keep KEPT_COLUMNS, and their
    category where the new one is null; the rest are inserted. Repeated keys
    within ``new``: the last wins. One shuffle of each side for the join; rows without a
    complete conflict key never conflict.
    """
    new = last_per_key(new, CONFLICT_KEY, order)
    moved = new.select(*SOURCE_KEY, F.col("site_id").alias("__site"), F.col("external_id").alias("__ext"))
    stay = current.join(moved, (current.source_db == moved.source_db) & (current.source_job_id == moved.source_job_id) & ((current.site_id != moved["__site"]) | (current.external_id != moved["__ext"])), "left_anti")
    n = new.select(*[F.col(c).alias(f"__n_{c}") for c in new.columns], F.lit(True).alias("__new"))
    on = [stay[c] == n[f"__n_{c}"] for c in CONFLICT_KEY]
    joined = stay.join(n, on[0] & on[1] & on[2], "full")

    def value(name: str) -> Column:
        if name not in new.columns or name in KEPT_COLUMNS:
            return stay[name]
        if name == "category":
            return F.coalesce(n["__n_category"], stay["category"])
        return F.when(F.col("__new"), n[f"__n_{name}"]).otherwise(stay[name])

    return joined.select(*[value(c).alias(c) for c in current.columns])


def record_exports(ledger: DataFrame, exported: DataFrame, keys: tuple[str, ...] = ("job_id", "destination")) -> DataFrame:
    """The ledger with ``exported`` added or refreshed: the latest row of each key."""
    return last_per_key(ledger.unionByName(exported), keys, "dt")


def cursor(rows: DataFrame, key: str = "source_db", number: str = "source_job_id") -> DataFrame:
    """Last seen id of each source, over all rows read, skipped ones included."""
    return rows.groupBy(key).agg(F.max(number).alias("last_job_id"))


def totals(rows: DataFrame, usable: Column, key: str = "source_db") -> DataFrame:
    """Rows fetched, processed and skipped of each source."""
    return rows.groupBy(key).agg(F.count("*").alias("fetched"), F.count_if(usable).alias("processed"), F.count_if(~usable).alias("skipped"))


def active(jobs: DataFrame, as_of: Column) -> DataFrame:
    """Active jobs that have not expired by ``as_of`` (strictly)."""
    return jobs.filter(F.col("is_active") & (F.col("expires_at").isNull() | (F.col("expires_at") > as_of)))


def keyset_page(df: DataFrame, key: str, after: int, size: int) -> DataFrame:
    """The next rows by key: a pushed comparison and a top-n, never a full sort."""
    return df.filter(F.col(key) > after).orderBy(key).limit(size)


def update_by_key(table: DataFrame, changes: DataFrame, key: str, columns: list[str], overwrite: bool = True) -> DataFrame:
    """``table`` with ``columns`` taken from ``changes`` for the keys that they hold; null changes leave the old value.

    ``overwrite=False`` fills only values that are null.
    """
    c = changes.select(F.col(key).alias("__key"), *[F.col(x).alias(f"__{x}") for x in columns])
    joined = table.join(c, table[key] == F.col("__key"), "left")
    pick = lambda x: F.coalesce(F.col(f"__{x}"), table[x]) if overwrite else F.coalesce(table[x], F.col(f"__{x}"))
    return joined.select(*[(pick(x) if x in columns else table[x]).alias(x) for x in table.columns])


def insert_absent(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``table`` and those of ``rows`` whose key it lacks, one of each."""
    new = rows.join(table.select(key), key, "left_anti").dropDuplicates([key])
    return table.unionByName(new.select(*table.columns))


def ranked_sample(df: DataFrame, by: Column, n: Column | int, within: list[str], first: Column | None = None) -> DataFrame:
    """At most ``n`` rows of each group in the order of ``first`` and ``by``."""
    order = ([first] if first is not None else []) + [by]
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*within).orderBy(*order)))
    return ranked.filter(F.col("__rank") <= n).drop("__rank")
