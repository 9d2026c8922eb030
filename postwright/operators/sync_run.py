"""A synchronisation run: every source by itself, with totals that leave failed sources out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postwright.functions import language as L
from postwright.operators import sync as S

TOTALS = "source_db string, fetched bigint, processed bigint, skipped bigint, last_job_id bigint, error string"


@dataclass
class Source:
    """The relations of one source, its defaults and what its configuration switches on."""

    jobs: DataFrame
    cities: DataFrame
    sites: DataFrame
    ledger: DataFrame | None = None
    regions: DataFrame | None = None
    country_code: str | None = None
    currency: str | None = None
    config: dict[str, str] = field(default_factory=dict)

    def on(self, key: str) -> bool:
        return str(self.config.get(key)) in ("1", "true", "True")


@dataclass
class Batch:
    """What a source adds: target rows, ledger rows, and its counts."""

    rows: DataFrame
    exported: DataFrame
    counts: tuple[int, int, int, int | None]


def read_source(name: str, source: Source, after: int, destination: str, now: Column, resync: bool = False, detected: Column | None = None) -> Batch:
    """New rows of a source as target rows. A source whose configuration wants the city's country but has none is refused."""
    by_city = source.on("country_code_in_city")
    if by_city and "country_code" not in source.cities.columns:
        raise ValueError(f"{name}: cities have no country_code")
    region = source.config.get("region_in_city") or "region"
    raw = S.fetch(source.jobs, source.cities, source.sites, None if resync else source.ledger, destination, after, source.regions, region if region in source.cities.columns else None)
    usable = L.fixed_length_code(F.col("city_country_code"), 2).isNotNull() if by_city else F.lit(True)
    fetched, processed, last = raw.agg(F.count("*"), F.count_if(usable), F.max("id")).first()
    rows = raw.filter(usable).withColumns(
        {
            "source_db": F.lit(name), "source_job_id": F.col("id"), "country_code": F.col("city_country_code") if by_city else F.lit(None).cast("string"),
            "currency": F.col("salary_currency") if source.on("currency_in_job") else F.lit(None).cast("string"),
        }
    )
    exported = rows.select(F.col("id").alias("job_id"), F.lit(destination).alias("destination"), F.col("site_id").cast("smallint").alias("site_id"), now.alias("dt"))
    return Batch(S.payload(rows, now, source.country_code, source.currency, detected), exported, (fetched, processed, fetched - processed, last))


def run(spark: SparkSession, sources: dict[str, Callable[[], Source]], cursors: dict[str, int], destination: str, now: Column, apply: Callable[[str, Batch], None], resync: bool = False) -> DataFrame:
    """Synchronises each source and returns TOTALS: a row per source and one (source_db null) for all that succeeded.

    ``sources``: name -> a function that opens it; ``apply`` writes a batch, and must be
    idempotent. A source that fails, whatever it is that fails, leaves the others alone and
    adds nothing to the totals. There are as many steps as sources; rows stay in Spark.
    """
    done = []
    for name, open_source in sources.items():
        try:
            batch = read_source(name, open_source(), 0 if resync else cursors.get(name, 0), destination, now, resync)
            apply(name, batch)
            done.append((name, *batch.counts, None))
        except Exception as failure:  # noqa: BLE001
            done.append((name, 0, 0, 0, cursors.get(name), f"{type(failure).__name__}: {str(failure).splitlines()[0] if str(failure) else ''}"))
    good = [d for d in done if d[5] is None]
    return spark.createDataFrame([*done, (None, *(sum(d[i] for d in good) for i in (1, 2, 3)), None, None)], TOTALS)
