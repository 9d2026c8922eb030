"""Toxicity by the nearest labelled examples: exact TF-IDF cosine, over all words and over telling words.

All sampled labelled examples, clean ones too, are indexed with the TF-IDF
weights of all their words. The most frequent words are dense columns, rare ones
inverted lists of postings; both are summed for every example. What the words between
can add is bounded by the greatest norm of these words in a block of alike examples:
only blocks whose greatest sum and bound reach the least similarity of a neighbour
(NEAR) are visited, and there similarities are exact. The nearest examples vote by a
high power of similarity, so that copies and close variants of an example take over
its label whatever words they hold; below NEAR a vote would count less than a
thousandth.

A second vote sees only telling words, those that are significantly more frequent
in toxic examples and mostly found there, so that one insult in a long text
still counts. These examples are stored as an inverted index in blocks, each
term of a block with its largest weight; a query visits blocks in the order of
their bounds and stops when no bound reaches its k-th similarity, so its
neighbours are exact. Their votes, weighted by similarity, are calibrated on a
fold of labelled rows that chose neither words nor examples. The score is the
greater of both votes, the evidence the nearest over all words. Document
frequencies are counted over all documents.

Defined results: a null or empty text has no neighbour; a text without a telling
word has the prior of such texts as its second vote. A word that no example holds
weighs as much as one of a single document. Texts of any length are scored whole. Of
equally near examples the one with the smaller id counts first. Rows are scored one by
one, repeated rows alike; of rows that share a labelled doc_id the one with the
smallest text hash teaches; a document labelled twice counts as toxic if one label says
so; null labels and ids teach nothing. Without labels all scores are 0. An empty table
gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import gc
import math
import pickle
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postwright.llm.common import forget, held_out, stage

#: Labelled rows that the classifier is fitted on, at most (by the order of a hash of their ids).
MAX_LABELLED = 20_000
#: A word's least toxic examples, least share of toxic ones among its examples, and least likelihood ratio (G2).
MIN_TOXIC, MIN_SHARE, MIN_G2 = 3, 0.6, 12.0
NEIGHBOURS, BLOCK, ALPHA = 15, 64, 1.0
#: Shares in which the driver fetches the examples.
FETCHES = 8
#: Over all words: words kept as dense columns, most postings of a rare word, texts compared and scored at once, the power of similarity that a
#: vote counts, and a neighbour's least similarity.
HEAD, RARE, AT_ONCE, SLICE, POWER, NEAR = 256, 200, 64, 512, 8, 0.4
THRESHOLD = 0.3
_TOKEN = re.compile(r"\w+")


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


@dataclass
class Whole:
    """All words of all sampled examples: frequent words as dense columns, rare ones as lists of (example, weight), those between as each example's own (word, weight) pairs."""

    words: np.ndarray
    idf: np.ndarray
    unknown: float
    head_of: np.ndarray
    head: np.ndarray
    start: np.ndarray
    rows: np.ndarray
    weights: np.ndarray
    middle_of: np.ndarray
    own: np.ndarray
    own_word: np.ndarray
    own_weight: np.ndarray
    norm: np.ndarray
    ids: np.ndarray
    labels: np.ndarray


@dataclass
class Model:
    """Everything that scoring needs; bounded by MAX_LABELLED."""

    terms: dict[str, int] = field(default_factory=dict)
    idf: np.ndarray = field(default_factory=lambda: np.empty(0))
    block_terms: list[np.ndarray] = field(default_factory=list)
    tiles: list[np.ndarray] = field(default_factory=list)
    bounds: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))
    ids: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    labels: np.ndarray = field(default_factory=lambda: np.empty(0))
    prior: float = 0.0
    raw: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))
    calibrated: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))
    hashes: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    term_of: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    whole: Whole | None = None


def select_terms(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> list[str]:
    """(term, toxic documents, clean documents) -> the terms that tell toxic documents."""
    out, total = [], toxic + clean
    for term, a, b in counts:
        if a < MIN_TOXIC or a < MIN_SHARE * (a + b):
            continue
        expected = toxic * (a + b) / total
        cells = ((a, expected), (b, a + b - expected), (toxic - a, toxic - expected), (clean - b, clean - (a + b - expected)))
        if a > expected and 2 * sum(x * math.log(x / y) for x, y in cells if x > 0 and y > 0) >= MIN_G2:
            out.append(term)
    return sorted(out)


def vector(model: Model, pairs: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(term, count) pairs -> term numbers and unit-length TF-IDF weights."""
    index = np.array([t for t, _ in pairs], np.int64)
    w = (1 + np.log(np.array([c for _, c in pairs], float))) * model.idf[index]
    return index, w / (np.sqrt((w * w).sum()) or 1.0)


def build_index(model: Model, examples: list[tuple[int, int, list[tuple[int, int]]]]) -> None:
    """(id, label, pairs) -> block-max lists; examples that share their strongest word stand together."""
    rows = []
    for doc, label, pairs in examples:
        index, w = vector(model, pairs)
        rows.append((int(index[w.argmax()]), doc, label, index, w))
    rows.sort(key=lambda r: (r[0], r[1]))
    model.ids, model.labels = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], float)
    blocks = [rows[i : i + BLOCK] for i in range(0, len(rows), BLOCK)]
    model.bounds = np.zeros((len(model.terms), len(blocks)))
    for b, block in enumerate(blocks):
        own = np.unique(np.concatenate([r[3] for r in block]))
        tile = np.zeros((len(own), len(block)))
        for k, row in enumerate(block):
            tile[np.searchsorted(own, row[3]), k] = row[4]
        model.block_terms.append(own)
        model.tiles.append(tile)
        model.bounds[own, b] = tile.max(axis=1)


def nearest(model: Model, index: np.ndarray, w: np.ndarray, k: int = NEIGHBOURS) -> list[tuple[float, int]]:
    """The k examples of greatest cosine as (similarity, example number), exact; ties to the smaller number."""
    bound = w @ model.bounds[index]
    best: list[tuple[float, int]] = []
    for b in np.argsort(-bound, kind="stable"):
        if bound[b] <= 0 or (len(best) == k and bound[b] < best[-1][0] - 1e-12):
            break
        own = model.block_terms[b]
        at = np.minimum(np.searchsorted(own, index), len(own) - 1)
        here = own[at] == index
        sims = w[here] @ model.tiles[b][at[here]]
        bar = best[-1][0] if len(best) == k else 0.0
        found = np.flatnonzero(sims >= max(bar, 1e-9))
        best = sorted([*best, *((round(float(sims[i]), 12), int(b) * BLOCK + int(i)) for i in found)], key=lambda x: (-x[0], x[1]))[:k]
    return best


def vote(model: Model, best: list[tuple[float, int]]) -> float:
    """Votes weighted by squared similarity, with the prior as ALPHA votes."""
    if not best:
        return 0.0
    s = np.array([x for x, _ in best]) ** 2
    return float((s @ model.labels[[i for _, i in best]] + ALPHA * model.prior) / (s.sum() + ALPHA))


def calibrate(model: Model, raw: np.ndarray, labels: np.ndarray) -> None:
    """Isotonic regression (pool adjacent violators) of labels on votes, smoothed by one prior row a step."""
    if not len(raw):
        return
    order = np.argsort(raw, kind="stable")
    steps: list[list[float]] = []  # sum of labels, rows, least vote, greatest vote
    for x, y in zip(raw[order], labels[order], strict=True):
        if steps and steps[-1][3] == x:
            steps[-1][0] += y
            steps[-1][1] += 1
        else:
            steps.append([y, 1.0, x, x])
        while len(steps) > 1 and steps[-2][0] * steps[-1][1] >= steps[-1][0] * steps[-2][1]:
            y2, n2, _, high = steps.pop()
            steps[-1] = [steps[-1][0] + y2, steps[-1][1] + n2, steps[-1][2], high]
    xs, ys = [], []
    for y, n, low, high in steps:
        p = (y + model.prior) / (n + 1)
        xs += [low, high]
        ys += [p, p]
    model.raw, model.calibrated = np.array(xs), np.maximum.accumulate(np.array(ys))


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    """The parts one after another; the list is emptied, so that none is held twice."""
    out = np.concatenate(parts)
    parts.clear()
    return out


def weigh(words: np.ndarray, counts: np.ndarray, sizes: np.ndarray, known: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ``sizes`` words of each example, one after another, with counts -> their places in ``known`` and unit-length weights."""
    word = np.searchsorted(known, words).astype(np.int32)
    w = (1 + np.log(counts.astype(np.float32))) * idf.astype(np.float32)[word]
    norms = np.sqrt(np.add.reduceat(np.square(w), (np.cumsum(sizes) - sizes)[sizes > 0], dtype=np.float64))
    w /= np.repeat(norms.astype(np.float32), sizes[sizes > 0])
    return word, w


def build_whole(ids: np.ndarray, labels: np.ndarray, sizes: np.ndarray, word: np.ndarray, w: np.ndarray, known: np.ndarray, idf: np.ndarray, n: int) -> Whole:
    """Examples (id, label, number of words) with the words and weights of ``weigh`` -> the index. Examples of one block share their strongest words."""
    size, often = len(ids), np.bincount(word, minlength=len(known))
    top = np.argsort(-often, kind="stable")[:HEAD]
    head_of = np.full(len(known), -1, np.int16)
    head_of[top] = np.arange(len(top))
    example = np.repeat(np.arange(size, dtype=np.int32), sizes)
    dense = head_of[word] >= 0
    head = np.zeros((size, len(top)), np.float32)
    head[example[dense], head_of[word[dense]]] = w[dense]
    word, example, w = word[~dense], example[~dense], w[~dense]
    strongest = np.zeros(size, np.int64)
    begins = np.flatnonzero(np.concatenate([[True], example[1:] != example[:-1]])) if len(example) else np.empty(0, np.int64)
    if len(begins):
        greatest = np.zeros(size, np.float32)
        greatest[example[begins]] = np.maximum.reduceat(w, begins)
        at = np.flatnonzero(w == greatest[example])[::-1]  # of equal ones the first
        strongest[example[at]] = word[at]
    place = np.lexsort((ids, strongest, head.argmax(axis=1) if len(top) else strongest))
    head, example = head[place], np.argsort(place).astype(np.int32)[example]
    between = (often > RARE) & (head_of < 0)
    middle_of = np.where(between, np.cumsum(between) - 1, -1).astype(np.int32)
    middle = between[word]
    order = np.argsort(example[middle], kind="stable")
    own_word, own_weight, owner = middle_of[word[middle]][order], w[middle][order], example[middle][order]
    own_word = own_word.astype(np.uint16 if between.sum() <= 1 << 16 else np.int32)
    own = np.searchsorted(owner, np.arange(size + 1)).astype(np.int32)
    norm = np.sqrt(np.bincount(owner, np.square(own_weight, dtype=np.float64), size)).astype(np.float32)
    word, example, w = word[~middle], example[~middle], w[~middle]
    order = np.argsort(word, kind="stable")
    start = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(known)))]).astype(np.int32)
    example = example[order].astype(np.uint16 if size <= 1 << 16 else np.int32)
    return Whole(known, idf, math.log((1 + n) / 2) + 1, head_of, head, start, example, w[order], middle_of, own, own_word, own_weight, norm, ids[place], labels[place])


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers first[0], ... (n[0] of them), first[1], ..., in a row."""
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())


def nearest_whole(whole: Whole, bags: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per bag (distinct word hashes, their counts): the k examples of greatest cosine, from NEAR on, and their similarities; ties to the smaller id."""
    out, size = [], len(whole.ids)
    blocks = -(-size // BLOCK)
    sums, middle = np.full(blocks * BLOCK, -1.0, np.float32), np.zeros(int(whole.middle_of.max(initial=-1)) + 1, np.float32)
    most = np.append(whole.norm, np.zeros(len(sums) - size, np.float32)).reshape(blocks, BLOCK).max(axis=1)
    for at in range(0, len(bags), AT_ONCE):
        part = bags[at : at + AT_ONCE]
        heads, others = np.zeros((len(part), whole.head.shape[1]), np.float32), []
        for i, (own, counts) in enumerate(part):
            place = np.minimum(np.searchsorted(whole.words, own), len(whole.words) - 1)
            hit = whole.words[place] == own
            w = (1 + np.log(counts)) * np.where(hit, whole.idf[place], whole.unknown)
            w = (w / (np.sqrt((w * w).sum()) or 1.0))[hit].astype(np.float32)
            place = place[hit]
            dense = whole.head_of[place] >= 0
            heads[i, whole.head_of[place[dense]]] = w[dense]
            others.append((place[~dense], w[~dense]))
        rough = heads @ whole.head.T
        for i, (place, w) in enumerate(others):
            between = whole.middle_of[place]
            rare, mine = place[between < 0], between[between >= 0]
            n = whole.start[rare + 1] - whole.start[rare]
            postings = _ranges(whole.start[rare], n)
            tail = np.bincount(whole.rows[postings], np.repeat(w[between < 0], n) * whole.weights[postings], size)
            np.add(rough[i], tail, out=sums[:size], casting="same_kind")
            reach = float(np.sqrt(np.square(w[between >= 0], dtype=np.float64).sum()))
            visited = np.flatnonzero(sums.reshape(blocks, BLOCK).max(axis=1) + reach * most >= NEAR - 1e-4)
            found = (visited[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            found = found[found < size]
            found = found[sums[found] + reach * whole.norm[found] >= NEAR - 1e-4]
            middle[mine] = w[between >= 0]
            n = whole.own[found + 1] - whole.own[found]
            pairs = _ranges(whole.own[found], n)
            rest = np.bincount(np.repeat(np.arange(len(found)), n), middle[whole.own_word[pairs]] * whole.own_weight[pairs], len(found))
            middle[mine] = 0
            scores = sums[found] + rest
            near = scores >= NEAR - 1e-6
            found, scores = found[near], scores[near]
            best = np.lexsort((whole.ids[found], -np.rint(scores * 1e5)))[:k]
            out.append((found[best], np.minimum(1.0, np.round(scores[best], 6))))
    return out


def whole_votes(whole: Whole | None, bags: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, list[tuple[int, float]]]]:
    """Per bag: the vote of its nearest examples against one of a clean example at similarity 1, and the nearest as (id, similarity)."""
    if whole is None:
        return [(0.0, [])] * len(bags)
    out = []
    for best, sims in nearest_whole(whole, bags):
        s = sims**POWER
        out.append((float(s @ whole.labels[best] / (s.sum() + 1)), [(int(whole.ids[i]), float(x)) for i, x in zip(best[:3], sims[:3], strict=True)]))
    return out


def _hashes(text: str):
    """All words of a text, hashed."""
    return F.coalesce(F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0)), lambda w: F.xxhash64(w)), F.array().cast("array<bigint>"))


def _lists(column) -> list[np.ndarray]:
    """A column of lists of hashes as arrays."""
    values, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False))
    return np.split(values, ends[:-1]) if len(ends) else []


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in parts of SLICE rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word hashes -> distinct ones and their counts."""
    for batch in batches:
        found = [np.unique(x, return_counts=True) for x in _lists(batch.column("hashes"))]
        words, counts = pa.array([w for w, _ in found], pa.list_(pa.int64())), pa.array([c for _, c in found], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], words, counts], names=["doc_id", "toxic", "fold", "words", "counts"])


def _examples(docs: DataFrame, texts: DataFrame) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(doc_id, toxic, fold, words, counts) of ``texts`` (bounded by MAX_LABELLED); all their words, sorted, with frequencies over all of ``docs``."""
    hashed = texts.select("doc_id", (F.col("toxic") == 1).cast("int").alias("toxic"), "fold", _hashes("text").alias("hashes"))
    bags = stage(hashed.mapInArrow(_bags, "doc_id long, toxic int, fold long, words array<long>, counts array<int>"), "tox-bags")
    known = bags.select(F.explode("words").alias("word")).distinct()
    every = docs.select(F.explode(F.array_distinct(_hashes("text"))).alias("word")).join(F.broadcast(known), "word", "left_semi")
    counted = every.groupBy("word").agg(F.count("*").alias("df")).toArrow()
    words, df = counted["word"].to_numpy(), counted["df"].to_numpy()
    order = np.argsort(words)
    return bags, words[order], df[order]


def _parts(bags: DataFrame) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of ``bags`` with words, counts and their numbers as arrays, a share of the examples at a time, as the driver is small."""
    for part in range(FETCHES):
        share = bags.filter(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(FETCHES)) == part).orderBy("doc_id")
        for batch in share.toArrow().combine_chunks().to_batches():
            words, counts = (batch.column(c).flatten().to_numpy() for c in ("words", "counts"))
            yield batch, words, counts, pa.compute.list_value_length(batch.column("words")).to_numpy()
        pa.default_memory_pool().release_unused()


def telling(model: Model, words: np.ndarray, counts: np.ndarray) -> list[tuple[int, int]]:
    """Distinct word hashes and their counts -> the telling words among them as term numbers and counts."""
    if not len(model.hashes) or not len(words):
        return []
    place = np.minimum(np.searchsorted(model.hashes, words), len(model.hashes) - 1)
    hit = model.hashes[place] == words
    return sorted(zip(model.term_of[place[hit]].tolist(), counts[hit].tolist(), strict=True))


def score_terms(model: Model, pairs: list[tuple[int, int]]) -> tuple[float, list[tuple[int, float]]]:
    """Score and evidence (id and similarity of the nearest examples) of a text's (term, count) pairs."""
    if not len(model.ids):
        return 0.0, []
    best = nearest(model, *vector(model, pairs)) if pairs else []
    raw = vote(model, best)
    value = 0.98 * float(np.interp(raw, model.raw, model.calibrated)) + 0.02 * raw
    return min(1.0, max(0.0, value)), [(int(model.ids[i]), s) for s, i in best[:3]]


def _scores(model: Model, hashes: list[np.ndarray]) -> list[tuple[float, list[tuple[int, float]]]]:
    """Score and evidence of each text, given as the hashes of its words."""
    bags, out, seen = [np.unique(x, return_counts=True) for x in hashes], [], {}
    for bag, (whole, near) in zip(bags, whole_votes(model.whole, bags), strict=True):
        key = tuple(telling(model, *bag))
        if key not in seen:
            seen[key] = score_terms(model, list(key))[0]
        out.append((max(seen[key], whole), near))
    return out


def packed(model: Model) -> bytes:
    """A model as the tasks get it: compressed, so that driver, broadcast and workers hold less."""
    return zlib.compress(pickle.dumps(model, pickle.HIGHEST_PROTOCOL), 1)


class _Unpacking:
    """A compressed model as a file to read from, so that it is never held whole as bytes."""

    def __init__(self, sent: bytes) -> None:
        self.sent, self.at, self.ready, self.inflate = sent, 0, bytearray(), zlib.decompressobj()

    def _fill(self, enough) -> None:
        while not enough() and self.at < len(self.sent):
            self.ready += self.inflate.decompress(self.sent[self.at : self.at + (1 << 18)])
            self.at += 1 << 18

    def _take(self, n: int) -> bytes:
        out = bytes(memoryview(self.ready)[:n])
        del self.ready[:n]
        return out

    def read(self, n: int) -> bytes:
        self._fill(lambda: len(self.ready) >= n)
        return self._take(n)

    def readline(self) -> bytes:
        self._fill(lambda: b"\n" in self.ready)
        end = self.ready.find(b"\n") + 1
        return self._take(end or len(self.ready))

    def readinto(self, into) -> int:
        done = 0
        while done < len(into):
            self._fill(lambda: bool(self.ready))
            n = min(len(self.ready), len(into) - done)
            if not n:
                break
            into[done : done + n] = memoryview(self.ready)[:n]
            del self.ready[:n]
            done += n
        return done


def unpacked(held: list[bytes]) -> Model:
    """The model of ``packed`` bytes, which are taken from ``held``: a task needs them once."""
    return pickle.load(_Unpacking(held.pop()))


def _scorer(sent: bytes):
    held = [sent]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, model = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64())])), unpacked(held)
        for part in _slices(batches):
            found = _scores(model, _lists(part.column("hashes")))
            evidence = [[{"doc_id": d, "similarity": s} for d, s in near] for _, near in found]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([x for x, _ in found], pa.float64()), pa.array(evidence, kind)], names=["doc_id", "score", "evidence"])

    return run


def _filter(sent: bytes | Broadcast):
    """The hashes of a text's words -> whether it isn't predicted toxic; the rows themselves stay in the JVM, and nothing is joined or shuffled.

    ``sent``: a packed model, or the broadcast of one, which a worker reads from its file
    for all its tasks: no packed copy is held beside it.
    """
    held = sent if isinstance(sent, Broadcast) else [sent]

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        forget()  # what earlier stages keep
        model = held.value if isinstance(held, Broadcast) else unpacked(held)
        for column in columns:
            kept = [x < THRESHOLD for at in range(0, len(column), SLICE) for x, _ in _scores(model, _lists(column.slice(at, SLICE)))]
            yield pa.array(kept, pa.bool_())

    return F.arrow_udf(run, "boolean")


def fit(docs: DataFrame, labels: DataFrame, teach=None) -> tuple[Model, DataFrame]:
    """The fitted model, and doc_id and text of every row of ``docs``.

    ``labels``: doc_id, toxic. ``teach``: which doc_ids may teach (a condition on
    doc_id). At most MAX_LABELLED labelled rows do, a quarter of them for the
    calibration. Document frequencies count every row.
    """
    docs = docs.select("doc_id", "text")
    labels = labels.select("doc_id", "toxic").filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
    if teach is not None:
        labels = labels.filter(teach)
    labels = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = docs.select("doc_id").filter("doc_id IS NOT NULL").distinct()
    labels = stage(labels.join(known, "doc_id", "left_semi").withColumn("order", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))), "tox-labelled")
    # only rows that can be among the first are ordered, however many rows are labelled
    share = min(1.0, (1.1 * MAX_LABELLED + 100) / max(1, labels.count()))
    sample = labels.filter(F.col("order") <= int(share * (1 << 30))).orderBy("order", "doc_id").limit(MAX_LABELLED).drop("order")
    sample = stage(sample.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4))), "tox-labels")
    # rows of one doc_id: the same one each time; the sample is bounded by MAX_LABELLED
    every = docs.join(F.broadcast(sample), "doc_id")
    texts = stage(every.groupBy("doc_id").agg(F.min_by(F.struct("text", "toxic", "fold"), F.struct(F.xxhash64("text"), "text")).alias("t")).select("doc_id", "t.*"), "tox-texts")
    own = texts.filter("fold <> 0")
    words = own.select("toxic", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\w+"), F.lit(0)))).alias("term"))
    sizes = {r["toxic"]: r["n"] for r in own.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sum(n for t, n in sizes.items() if t != 1)
    per_term = words.groupBy("term").agg(F.sum((F.col("toxic") == 1).cast("int")).alias("a"), F.sum((F.col("toxic") != 1).cast("int")).alias("b"))
    rows = per_term.filter((F.col("a") >= MIN_TOXIC) & (F.col("a") >= MIN_SHARE * (F.col("a") + F.col("b")))).withColumn("hash", F.xxhash64("term")).collect()  # bounded by the sample
    model = Model(prior=toxic / max(1, toxic + clean))
    model.terms = {t: i for i, t in enumerate(select_terms([(r["term"], r["a"], r["b"]) for r in rows], toxic, clean))}

    hashes = {r["term"]: r["hash"] for r in rows}
    by_hash = sorted((hashes[t], i) for t, i in model.terms.items())
    model.hashes, model.term_of = np.array([h for h, _ in by_hash], np.int64), np.array([i for _, i in by_hash], np.int64)
    n = docs.count()
    bags, known, df = _examples(docs, texts)
    idf = np.log((1 + n) / (1 + df)) + 1
    model.idf = np.zeros(len(model.terms))
    model.idf[model.term_of] = idf[np.searchsorted(known, model.hashes)]
    examples, probes, ids, marks, lengths, word_parts, weights = [], [], [], [], [], [], []
    for batch, words, counts, sizes in _parts(bags):
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        for i, (doc, label, fold) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "toxic", "fold")), strict=True)):
            pairs = telling(model, words[offsets[i] : offsets[i + 1]], counts[offsets[i] : offsets[i + 1]])
            if fold == 0:
                probes.append((pairs, label))
            elif pairs:
                examples.append((doc, label, pairs))
            ids.append(doc)
            marks.append(float(label))
        if len(words):
            word, w = weigh(words, counts, sizes, known, idf)
            word_parts.append(word)
            weights.append(w)
        lengths.append(sizes)
    if examples:
        build_index(model, examples)
        raw = np.array([vote(model, nearest(model, *vector(model, p))) if p else 0.0 for p, _ in probes])
        calibrate(model, raw, np.array([y for _, y in probes], float))
    if word_parts:
        pa.default_memory_pool().release_unused()
        model.whole = build_whole(np.array(ids, np.int64), np.array(marks), np.concatenate(lengths), _joined(word_parts), _joined(weights), known, idf, n)
    gc.collect()
    pa.default_memory_pool().release_unused()
    return model, docs


def score(docs: DataFrame, labels: DataFrame, teach=None) -> DataFrame:
    """doc_id, score, evidence (the nearest examples) of every row of ``docs``."""
    sent = packed(fit(docs, labels, teach)[0])
    return docs.select("doc_id", _hashes("text").alias("hashes")).mapInArrow(_scorer(sent), "doc_id long, score double, evidence array<struct<doc_id:long,similarity:double>>")


def without_toxic(docs: DataFrame, labels: DataFrame, teach=None) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic; all columns."""
    return docs.filter(_filter(docs.sparkSession.sparkContext.broadcast(fit(docs, labels, teach)[0]))(_hashes("text")))


def op2(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = score(docs, labels, ~held_out(F.col("doc_id"), 4, 2))
    return found.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")
