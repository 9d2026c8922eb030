"""Registered queries against their oracles in DuckDB, over whole tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from postwright.plans import catalogue
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    if isinstance(x, decimal.Decimal):
        return round(float(x), 6)
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_oracle(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(x) for x in r) for r in df.select(*columns).collect()), key=repr)
    picked = ", ".join(f'"{c}"' for c in columns)
    want = sorted((tuple(plain(x) for x in r) for r in duck.sql(f"SELECT {picked} FROM ({catalogue.oracle_sql()[name]})").fetchall()), key=repr)
    assert got == want


def test_entry_works_without_the_optional_subpackage(monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(entry, "_llm_registry", lambda: None)
    assert set(entry.queries()) == set(catalogue.queries()) and set(entry.oracle_sql()) == set(catalogue.oracle_sql())


def test_upsert_twice_equals_once(spark):
    from postwright.operators import sync as S
    from postwright.plans.sync_queries import _snapshots

    old, new = _snapshots(spark, SF)
    once = S.upsert(old, new)
    assert sorted(map(repr, S.upsert(once, new).collect())) == sorted(map(repr, once.collect()))


def test_csv_round_trip(spark, tmp_path):
    from postwright.operators import labelling as B

    rows = spark.createDataFrame([('a "q", b', "x\ny", "", 1), ("é", "", "line", 2)], "title string, original_category string, description_plaintext string, category_id bigint")
    B.write_training_csv(rows, f"{tmp_path}/csv")
    assert sorted(B.read_training_csv(spark, f"{tmp_path}/csv").collect()) == sorted(rows.collect())
