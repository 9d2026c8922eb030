"""Language-model scores of whole documents: an add-one unigram base and a gated recurrent network.

Word counts are taken over all training documents. The network knows the most
frequent words, a number that grows with the number of different words, and one symbol
for all others, whose own probability is their share among the others. It is
started on some documents in the driver; then every training document takes part:
training documents are dealt into shards by a hash of id and text, as many as there
are tokens for, each shard trains its own copy in a fixed order, and the copies'
mean, weighted by tokens and summed in the order of the shards, is the model. Neither
depends on how rows lie in partitions, so neither do scores (but for rounding).

Defined results: a null or empty text is the end alone; it is scored, and counts in
training. Texts of any length are scored whole, as the state is carried from window to
window. Words of equal count are ranked by their bytes. Rows are scored one by one, so
repeated rows get equal scores; a null doc_id is a training row. Without training
documents every token is unknown. An empty table gives an empty table; extra
columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postwright.llm import gru
from postwright.llm.common import held_out, stage
from postwright.llm.textset import words

#: Words whose counts every task holds; other words' counts are joined.
FREQUENT = 200_000
#: Words counted in a task before they are sent on, tokens trained or scored at once, tokens of a shard, documents that start the network.
COUNTED, CHUNK, SHARD, START_DOCS = 300_000, 4_000_000, 4_000_000, 1_500
START_RATE, RATE = 0.02, 0.01
#: Least number of classes of the network; copies that one task sums.
CLASSES, SUMMED = 32, 16


def classes_for(types: int) -> int:
    """Classes of the network for this many different words: the fourth root, so that the vocabulary is about its square."""
    return max(CLASSES, round(types**0.25))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts -> words and their counts so far, bounded; the end's word is null."""

    def send(counts: Counter, docs: int) -> pa.RecordBatch:
        keys, values = [*counts.keys(), None], [*counts.values(), docs]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(values, pa.int64())], names=["word", "n"])

    counts, docs = Counter(), 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            counts.update(words(text))
            docs += 1
            if len(counts) > COUNTED:
                yield send(counts, docs)
                counts, docs = Counter(), 0
    if docs:
        yield send(counts, docs)


_ENCODED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, n_other long, base_part double, other_part double, ids binary, rare array<binary>"


def _symbols(vocabulary: int):
    """The type that holds a symbol."""
    return np.uint16 if vocabulary <= 1 << 16 else np.uint32


def _encoder(frequent: list[tuple[bytes, int]], end_count: int, vocabulary: int, kind):
    """Texts -> symbols, sums over frequent words, and the rare words whose counts are elsewhere."""
    place = {w: i for i, (w, _) in enumerate(frequent)}
    # the last entry is a rare word's, of which nothing is known here
    logs = np.append(np.log10(np.array([c for _, c in frequent], float) + 1), 0.0)
    symbols = np.full(len(frequent) + 1, gru.OTHER, kind)
    symbols[:vocabulary] = np.arange(vocabulary) + gru.SPECIAL
    end = np.array([gru.END], kind).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, none = TaskContext.get().partitionId() << 33, len(frequent)
        for batch in batches:
            columns: list[list] = [[] for _ in range(10)]
            for doc_id, held, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found = words(text)
                at = np.fromiter(map(place.get, found, repeat(none)), np.int64, len(found))
                ids, rare = symbols[at], [found[i] for i in np.flatnonzero(at == none)]
                part = logs[at]
                known = len(found) - len(rare) + (end_count > 0)
                values = (row, doc_id, held, len(found) + 1, known, int((ids == gru.OTHER).sum()), float(part.sum()) + np.log10(end_count + 1), float(part[ids == gru.OTHER].sum()), ids.tobytes() + end, rare)
                for column, value in zip(columns, values, strict=True):
                    column.append(value)
                row += 1
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in _ENCODED.split(", ")])

    return run


def _chunks(batches: Iterator[pa.RecordBatch], kind) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Rows (row, ids) gathered until they hold CHUNK tokens: (rows, symbols)."""
    keys, docs, tokens = [], [], 0
    for batch in batches:
        for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            keys.append(key)
            docs.append(np.frombuffer(raw, kind).astype(np.int32))
            tokens += len(docs[-1])
            if tokens >= CHUNK:
                yield keys, docs
                keys, docs, tokens = [], [], 0
    if docs:
        yield keys, docs


def _ordered(doc_ids: list, raw: list[bytes], kind) -> list[np.ndarray]:
    """Symbols of documents in an order that only depends on their ids and texts."""
    order = sorted(range(len(raw)), key=lambda i: (doc_ids[i] is None, doc_ids[i] or 0, raw[i]))
    return [np.frombuffer(raw[i], kind).astype(np.int32) for i in order]


def _train(flat: np.ndarray, classes: int, kind):
    """A shard's documents -> its copy of the parameters after them, with its tokens as weight."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        copies = np.repeat(np.arange(table.num_rows), table["copies"].to_numpy()).tolist()
        doc_ids, raw = table["doc_id"].to_pylist(), table["ids"].to_pylist()
        docs = _ordered([doc_ids[i] for i in copies], [raw[i] for i in copies], kind)
        trainer, tokens = gru.Trainer(gru.restore(flat, classes), RATE), sum(map(len, docs))
        trainer.learn(docs)
        weighted = gru.flatten(trainer.p).astype(np.float64) * tokens
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "weight": pa.array([float(tokens)]), "p": pa.array([weighted], pa.list_(pa.float64()))})

    return run


def _sum(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """SUMMED weighted copies at most -> their sum, in the order of their shards."""
    order = np.argsort(table["shard"].to_numpy())
    p = np.zeros(len(table["p"][0]))
    for i in order:
        p += table["p"][int(i)].values.to_numpy()
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "weight": pa.array([float(table["weight"].to_numpy().sum())]), "p": pa.array([p], pa.list_(pa.float64()))})


def _mean(copies: DataFrame, shards: int) -> np.ndarray | None:
    """The weighted mean of the shards' copies, summed by SUMMED at a time; None without copies."""
    schema = "shard long, weight double, p array<double>"
    copies = stage(copies, "lm-copies")
    while shards > 1:
        copies = copies.withColumn("shard", F.expr(f"shard div {SUMMED}"))
        copies, shards = stage(copies.groupBy("shard").applyInArrow(_sum, schema), "lm-sums"), -(-shards // SUMMED)
    found = copies.first()  # one row, of as many numbers as the network has parameters
    return None if found is None else np.array(found["p"]) / found["weight"]


def _score(flat: np.ndarray, classes: int, kind):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = gru.restore(flat, classes)
        for keys, docs in _chunks(batches, kind):
            logs = gru.log_likelihoods(p, docs) / np.log(10)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(logs)], names=["row", "network"])

    return run


def fit_network(training: DataFrame, counts: np.ndarray, classes: int, docs: int, tokens: int) -> np.ndarray:
    """``training(doc_id, ids)``: symbols of ``docs`` documents with ``tokens`` tokens -> the network's parameters. ``counts``: of the symbols."""
    kind = _symbols(len(counts))
    # rows whose hash of id and text is low, repeated ones once: about START_DOCS wherever they lie
    share = min(1.0, START_DOCS / max(1, docs))
    first = training.withColumn("hash", F.xxhash64("doc_id", "ids")).filter(F.pmod("hash", F.lit(1 << 30)) < int(share * (1 << 30))).distinct().collect()
    trainer = gru.Trainer(gru.start(counts, classes), START_RATE)
    start = _ordered([r["doc_id"] for r in first], [bytes(r["ids"]) for r in first], kind)
    for _ in range(4 if start else 0):
        trainer.learn(start)
    flat, shards = gru.flatten(trainer.p), max(1, -(-tokens // SHARD))
    # rows that repeat id and text fall together before the shuffle, and their copies are dealt evenly
    same = training.groupBy(F.xxhash64("ids", "doc_id").alias("hash")).agg(F.first("doc_id").alias("doc_id"), F.first("ids").alias("ids"), F.count("*").alias("n"))
    same = same.withColumn("parts", F.least("n", F.lit(shards))).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    copies = F.expr("n div parts") + (F.col("k") < F.col("n") % F.col("parts")).cast("long")
    dealt = same.select("doc_id", "ids", copies.alias("copies"), F.pmod(F.col("hash") % shards + F.col("k"), F.lit(shards)).alias("shard"))
    found = _mean(dealt.groupBy("shard").applyInArrow(_train(flat, classes, kind), "shard long, weight double, p array<double>"), shards)
    return flat if found is None else found.astype(np.float32)


def score(docs: DataFrame, is_held_out) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; ``is_held_out`` is a column."""
    docs = docs.select("doc_id", is_held_out.alias("held_out"), "text")
    counts = docs.filter(~F.col("held_out")).select("text").mapInArrow(_count, "word binary, n long")
    counts = stage(counts.groupBy("word").agg(F.sum("n").alias("n")), "lm-counts")
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.col("word").isNull(), F.col("n"))).alias("docs")).first()
    train_tokens, types, end_count = total["n"] or 0, total["v"], total["docs"] or 0
    # the least count that at most FREQUENT words reach, from how many words have each count: no task sends a top list
    sizes, least, room = counts.filter("word IS NOT NULL").groupBy("n").agg(F.count("*").alias("words")), None, FREQUENT
    for r in sizes.orderBy(F.desc("n")).limit(FREQUENT).collect():
        room -= r["words"]
        if room < 0:
            break
        least = r["n"]
    top = counts.filter("word IS NOT NULL").filter(F.col("n") >= least).collect() if least is not None else []
    frequent = sorted(((bytes(r["word"]), r["n"]) for r in top), key=lambda x: (-x[1], x[0]))
    classes = classes_for(types)
    vocabulary = min(len(frequent), classes * classes)
    kind = _symbols(gru.vocabulary(classes))

    encoded = docs.select("doc_id", "held_out", "text").mapInArrow(_encoder(frequent, end_count, vocabulary, kind), _ENCODED)
    encoded = stage(encoded, "lm-encoded")

    symbol_counts = np.zeros(gru.vocabulary(classes))
    symbol_counts[gru.END] = end_count
    symbol_counts[gru.SPECIAL : vocabulary + gru.SPECIAL] = [n for _, n in frequent[:vocabulary]]
    other_tokens = train_tokens - symbol_counts.sum()
    other_types = max(0, types - vocabulary - (end_count > 0))
    symbol_counts[gru.OTHER] = other_tokens
    training = encoded.filter(~F.col("held_out")).select("doc_id", "ids")
    flat = fit_network(training, symbol_counts, classes, end_count, train_tokens)

    network = encoded.select("row", "ids").mapInArrow(_score(flat, classes, kind), "row long, network double")
    rare = encoded.select("row", F.explode("rare").alias("word")).join(counts.filter("word IS NOT NULL"), "word")
    rare = rare.groupBy("row").agg(F.count("*").alias("seen"), F.sum(F.log10(F.col("n") + 1)).alias("part"))
    whole = encoded.drop("ids", "rare").join(network, "row").join(rare, "row", "left")
    part, seen = F.coalesce("part", F.lit(0.0)), F.coalesce("seen", F.lit(0))
    base = F.col("base_part") + part - F.col("n_tokens") * F.lit(float(np.log10(train_tokens + types + 1)))
    others = F.col("other_part") + part - F.col("n_other") * F.lit(float(np.log10(other_tokens + other_types + 1)))
    return whole.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + seen).alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"), (F.col("network") + others).alias("score"),
    )


def op8(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), held_out(F.col("doc_id"), 7, 2))
