"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postwright.sources.shared import shared_dir, stage

__all__ = ["WORD", "forget", "held_out", "replace_text", "shared_dir", "stage", "table", "worker_keeps"]

#: A word: a maximal run of anything but ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"

_KEPT: dict = {}


def worker_keeps(key, make):
    """``make()``, kept by a Python worker for its later tasks; one thing at a time, so that what several operators keep doesn't add up."""
    if key not in _KEPT:
        forget()
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    """Drops what the worker keeps: its memory is needed for something else."""
    if _KEPT:
        _KEPT.clear()
        gc.collect()  # parts of it refer to one another


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id, modulus: int, remainder: int):
    """Fold of a document: crc32 of its id as text; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def replace_text(changed: DataFrame, docs: DataFrame) -> DataFrame:
    """(__doc struct of a row of ``docs``, __text) -> the columns of ``docs`` with the new text; n_chars follows it, if there is one."""
    new = {"text": F.col("__text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("__text").cast(dict(docs.dtypes)["n_chars"])
    return changed.select(*[new.get(c, F.col(f"__doc.`{c}`")).alias(c) for c in docs.columns])
