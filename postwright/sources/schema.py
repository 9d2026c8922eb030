"""Declared schemas of the target tables: creating them, probing sources, and bringing stored tables of any version to the declared one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from postwright.sources import dims

TABLES = {"jobs": dims.JOBS, "job_labelling": dims.JOB_LABELLING, "sync_state": dims.SYNC_STATE, "export_ledger": dims.LEDGER, "categories": "id bigint, title string", "category_map": "original_category string, category_id bigint"}


def declared(name: str) -> StructType:
    return StructType.fromDDL(TABLES[name])


def create(spark: SparkSession, base: str) -> None:
    """Empty tables for those of TABLES that are not yet in the folder ``base``; existing ones stay as they are."""
    for name in TABLES:
        spark.createDataFrame([], declared(name)).write.mode("ignore").parquet(f"{base}/{name}")


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path holds anything, asked of its file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def column_exists(table: DataFrame, name: str) -> bool:
    return name in table.columns


def conform(table: DataFrame, ddl: str, renamed: dict[str, str] | None = None) -> DataFrame:
    """A stored table under the declared schema: old names (``renamed``: old -> new) taken over, missing columns null, others dropped, types cast."""
    old = {new: name for name, new in (renamed or {}).items() if name in table.columns}
    source = lambda f: F.col(f.name) if f.name in table.columns else F.col(old[f.name]) if f.name in old else F.lit(None)
    return table.select(*[source(f).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(ddl).fields])


def load_seeds(table: DataFrame | None, seeds: DataFrame, key: str) -> DataFrame:
    """Seed rows on top of what is stored: a seed replaces the row with its key, so that loading twice changes nothing."""
    return seeds if table is None else table.join(seeds.select(key), key, "left_anti").select(*seeds.columns).unionByName(seeds)


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """The category mapping of a CSV file with a header; labels that differ in case only count once."""
    rows = spark.read.schema(TABLES["category_map"]).option("header", True).csv(path)
    return rows.groupBy(F.lower("original_category").alias("original_category")).agg(F.min("category_id").alias("category_id"))


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 1, **options: str) -> DataFrame:
    """A source relation over JDBC; with ``bounds`` its rows are read in ``parts`` ranges of the key. Filters and columns reach the database."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if key and bounds and parts > 1:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load()
