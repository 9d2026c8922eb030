"""Registration of queries next to their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from postwright.sources.postings import postings_sql

Query = Callable[[SparkSession, str], DataFrame]
#: Prefix of oracles over the derived postings view.
P = f"WITH p AS ({postings_sql(False)})"


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, oracle: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
        def keep(query: Query) -> Query:
            key = name or query.__name__
            self.queries[key] = query
            if oracle is not None:
                self.oracles[key] = oracle
            return query

        return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
