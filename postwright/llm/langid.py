"""Language of web pages by Bayesian fusion of evidence.

Text likelihoods come from hashed byte trigrams counted over labelled documents.
Added to them are how likely pages of a language declare the page's markup
language, and a prior of its host, smoothed hierarchically: host towards its
domain, domain towards its address suffix, suffix towards all pages. The counts
behind both are grouped sums of the text-only posteriors over all pages; a page's
own share is taken out of its host's.

Defined results: a null or empty page has no text likelihood, and its host and
declaration decide; a null url has the empty host, suffix and domain. Pages of any
length are read whole, though their trigrams count for EFFECTIVE at most. Without
labelled documents lang is null. Rows are judged one by one, so repeated rows get
equal results; ties go to the language that sorts first; extra columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postwright.llm.common import stage

SLOTS = 1 << 15
#: Trigrams that a text's evidence counts for at most, weights of the smoothing, parts of a hot host.
EFFECTIVE, HOST_WEIGHT, DECLARED_WEIGHT, SALTS = 60.0, 8.0, 2.0, 16
_DROP = re.compile(r"(?is)<(script|style|head|nav|footer|aside)\b.*?</\1\s*>|<!--.*?-->")
_TAG = re.compile(r"<[^>]*>")
_SPACE = re.compile(r"\s+")
_DECLARED = re.compile(r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})")


def page_text(page: str | None) -> str:
    return _SPACE.sub(" ", html.unescape(_TAG.sub(" ", _DROP.sub(" ", page)))).strip() if page else ""


def declared(page: str | None) -> str:
    found = _DECLARED.search(page or "")
    return found[1].lower() if found else ""


def address(url: str | None) -> tuple[str, str, str]:
    """Host, domain and suffix of a url; an unreadable one has empty ones."""
    try:
        host = (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        host = ""
    parts = host.split(".")
    return host, ".".join(parts[-2:]), parts[-1]


def slots(text: str) -> np.ndarray:
    """Hashed trigrams of a text's lower-case bytes."""
    b = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    if len(b) < 4:
        return np.empty(0, np.int64)
    code = (b[:-2] * np.uint32(65599) + b[1:-1]) * np.uint32(65599) + b[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64) & (SLOTS - 1)


def _count(languages: list[str]):
    place = {x: i for i, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(languages), SLOTS), np.int64)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text and lang in place:
                    counts[place[lang]] += np.bincount(slots(text), minlength=SLOTS)
        lang, slot = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(slot.astype(np.int32)), pa.array(counts[lang, slot])], names=["lang", "slot", "n"])

    return run


def _evidence(table: np.ndarray):
    """Pages -> host, domain, suffix, declared language and the text's log-likelihood by language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, ll, said = [], [], []
            for url, page in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                at = slots(page_text(page))
                mean = table[:, at].mean(axis=1) if len(at) else np.zeros(len(table))
                ll.append((mean - mean.max(initial=-np.inf)) * (EFFECTIVE * len(at) / (EFFECTIVE + len(at))) if len(table) else [])
                hosts.append(address(url))
                said.append(declared(page))
            columns = [pa.array(x, pa.string()) for x in (zip(*hosts, strict=True) if hosts else ([], [], []))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(said, pa.string()), pa.array([list(x) for x in ll], pa.list_(pa.float64()))], names=["page_id", "host", "domain", "suffix", "declared", "text_ll"])

    return run


def _softmax(x):
    e = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def _summed(df: DataFrame, keys: list[str], n: int, column: str) -> DataFrame:
    """Element-wise sums of an array column by key, partially aggregated before the shuffle."""
    return df.groupBy(*keys).agg(F.array(*[F.sum(F.col(column)[i]) for i in range(n)]).alias(f"{keys[0]}_sum"))


def _towards(counts, prior, weight: float):
    """Dirichlet smoothing of counts towards a prior."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, b: a + b)
    return F.zip_with(counts, prior, lambda c, p: (c + weight * p) / (total + weight))


def detect(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """page_id, lang, confidence, text_lang, declared, host and posterior (by language) of every page.

    ``labelled``: text, lang. The text model holds languages x SLOTS numbers.
    """
    labelled = labelled.select("lang", "text").filter("lang IS NOT NULL")
    languages = sorted(r["lang"] for r in labelled.select("lang").distinct().collect())
    n = len(languages)
    counted = labelled.mapInArrow(_count(languages), "lang int, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).collect()
    table = np.full((n, SLOTS), 0.5)
    for r in counted:
        table[r["lang"], r["slot"]] += r["n"]
    table = np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32) if n else table
    found = pages.select("page_id", "url", "html").mapInArrow(_evidence(table), "page_id long, host string, domain string, suffix string, declared string, text_ll array<double>")
    if not n:
        return found.select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("text_lang"), "declared", "host", F.lit(None).cast("map<string,double>").alias("posterior"))
    found = stage(found.withColumn("own", _softmax(F.col("text_ll"))), "lid-evidence")

    by_host = stage(_summed(found, ["host", "domain", "suffix"], n, "own"), "lid-hosts")
    by_domain = _summed(by_host, ["domain", "suffix"], n, "host_sum")
    by_suffix = _summed(by_host, ["suffix"], n, "host_sum")
    everything = by_suffix.agg(F.array(*[F.sum(F.col("suffix_sum")[i]) for i in range(n)]).alias("all_sum"))
    overall = everything.first()["all_sum"]
    overall = np.array([x or 0.0 for x in overall]) + 1
    whole = F.array(*[F.lit(float(x)) for x in overall / overall.sum()])
    suffixes = by_suffix.select("suffix", _towards(F.col("suffix_sum"), whole, HOST_WEIGHT).alias("suffix_prior"))
    domains = by_domain.join(suffixes, "suffix").select("domain", "suffix", _towards(F.col("domain_sum"), F.col("suffix_prior"), HOST_WEIGHT).alias("domain_prior"))
    hosts = by_host.join(domains, ["domain", "suffix"]).select("host", "host_sum", "domain_prior")
    # P(declared | language): the share of a language's pages that declare it
    said = _summed(found, ["declared"], n, "own")
    says = said.select("declared", F.zip_with(F.col("declared_sum"), F.array(*[F.lit(float(x)) for x in overall]), lambda c, t: (c + F.lit(DECLARED_WEIGHT / n)) / (t + DECLARED_WEIGHT)).alias("says"))

    # a hot host's pages are spread by a salt, and its prior is copied to each part
    salted = found.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    hosts = hosts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    says = says.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = salted.join(hosts, ["host", "salt"]).join(says, ["declared", "salt"])
    others = F.zip_with("host_sum", "own", lambda c, o: F.greatest(c - o, F.lit(0.0)))
    joined = joined.withColumn("prior", _towards(others, F.col("domain_prior"), HOST_WEIGHT))
    joined = joined.withColumn("log_posterior", F.zip_with(F.zip_with("text_ll", "prior", lambda t, p: t + F.log(p)), "says", lambda t, s: t + F.log(s)))
    joined = joined.withColumn("p", _softmax(F.col("log_posterior")))
    names = F.array(*[F.lit(x) for x in languages])
    best = lambda column: F.element_at(names, F.array_position(column, F.array_max(column)).cast("int"))
    has_text = F.array_max("text_ll") > F.array_min("text_ll")
    return joined.select("page_id", best("p").alias("lang"), F.array_max("p").alias("confidence"), F.when(has_text, best("text_ll")).alias("text_lang"), "declared", "host", F.map_from_arrays(names, F.col("p")).alias("posterior"))


def op1(spark, sf_dir: str) -> DataFrame:
    found = detect(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("page_id", "lang", F.round("confidence", 6).alias("confidence"), "text_lang", "declared", "host")
