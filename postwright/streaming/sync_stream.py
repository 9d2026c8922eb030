"""Incremental synchronisation as a stream: what is new since the checkpoint is upserted, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def run_available(spark: SparkSession, source: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None]) -> None:
    """Processes all that ``source`` (a streaming DataFrame) has now and stops.

    Offsets in ``checkpoint`` take the place of a cursor table. ``apply`` must be
    idempotent for a batch id: a batch may be replayed after a failure.
    """
    query = source.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(apply).start()
    query.awaitTermination()


def snapshot_sink(path: str, merge: Callable[[DataFrame | None, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A sink that keeps versioned snapshots: ``path/v=<batch>`` is the merge of the version before and the batch.

    Writing a version again gives the same version, so a replayed batch does no harm.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{path}/v={number - 1}") if number else None
        merge(before, batch).write.mode("overwrite").parquet(f"{path}/v={number}")

    return apply
