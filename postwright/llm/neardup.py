"""Near-duplicate documents by SetSketch banding, joint estimation and exact verification.

Defined results: a document's shingle set is empty if its text is null, empty or
has no word; it then links with nothing, is its own component and always stays. Texts
of any length are sketched whole, in bounded memory. Rows that share a doc_id are
separate documents unless their texts link; rows repeated word for word link, so
one of them stays. Of equal choices (texts of a set, rows of a component) the one with
the smallest doc_id counts, then that with the smallest hash of its text. A null
doc_id is carried through: it may link others, and is its component's id only if the
component holds no other id. An empty table gives an empty table. Extra columns, of
whatever names, are ignored by ``near_duplicates`` and untouched by ``keep_first``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postwright.llm import setsketch as sk
from postwright.llm.common import WORD, stage
from postwright.llm.components import connected_components
from postwright.llm.textset import WordHashes, set_digest, shingles

#: Sets, and shingles of sets, of half a block of an unresolved bucket, about; parts into which a bucket's sets are dealt.
BLOCK, BLOCK_SHINGLES, SALTS = 512, 400_000, 64

#: Bits of a filter for each value, and of all of it at most (32 MB).
FILTER_BITS, FILTER_MOST = 16, 1 << 28

_SKETCH = "doc_id long, text_key long, n_shingles long, set_id binary, regs binary, bands array<long>"


def _sketcher(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            counts, ids, regs, bands = [], [], [], []
            for text in batch.column(2).to_pylist():
                x = shingles(text, size, cache)
                counts.append(len(x))
                ids.append(set_digest(x))
                r = sk.registers(x) if len(x) else None
                regs.append(None if r is None else r.tobytes())
                bands.append(None if r is None else sk.band_keys(r))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(ids, pa.binary()), pa.array(regs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "text_key", "n_shingles", "set_id", "regs", "bands"],
            )

    return run


def _likely(threshold: float):
    """Pairs with both sketches -> the pairs worth verifying."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a = np.frombuffer(b"".join(batch.column("a_regs").to_pylist()), np.uint16).reshape(-1, sk.REGISTERS)
            b = np.frombuffer(b"".join(batch.column("b_regs").to_pylist()), np.uint16).reshape(-1, sk.REGISTERS)
            est = sk.estimate((a > b).sum(1), (a < b).sum(1), batch.column("a_n").to_numpy(), batch.column("b_n").to_numpy())
            yield batch.select(["a", "b"]).filter(pa.array(est >= sk.margin(threshold)))

    return run


def _verifier(size: int, percent: int):
    """Pairs with both texts -> the pairs whose full sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, last_id, last = WordHashes(), None, None
        for batch in batches:
            keep = []
            for a, x, y in zip(batch.column("a").to_pylist(), batch.column("a_text").to_pylist(), batch.column("b_text").to_pylist(), strict=True):
                if a != last_id:
                    last_id, last = a, shingles(x, size, cache)
                other = shingles(y, size, cache)
                both = len(np.intersect1d(last, other, assume_unique=True))
                keep.append(100 * both >= percent * (len(last) + len(other) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _likely_pairs(key: tuple[pa.Scalar, ...], table: pa.Table, threshold: float, percent: int) -> tuple[list[tuple[float, int, int]], np.ndarray]:
    """One pair of blocks of an unresolved bucket -> likely pairs of rows across components with their estimates, and the rows' components.

    A pair is looked at in its first common band only.
    """
    table = table.combine_chunks()
    i, j = key[1].as_py(), key[2].as_py()
    regs = np.frombuffer(b"".join(table["regs"].to_pylist()), np.uint16).reshape(-1, sk.REGISTERS)
    bands = table["bands"].combine_chunks().flatten().to_numpy().reshape(-1, sk.BANDS)
    chunk, n, comp = table["chunk"].to_numpy(), table["n_shingles"].to_numpy(), np.unique(np.array(table["component"].to_pylist(), object), return_inverse=True)[1]
    where = int(np.flatnonzero(bands[0] == key[0].as_py())[0])
    left, right = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
    likely = []
    for x in left:
        ys = right[right > x] if i == j else right
        ys = ys[comp[ys] != comp[x]]
        ys = ys[(100 * np.minimum(n[ys], n[x]) >= percent * np.maximum(n[ys], n[x])) & ((bands[ys, :where] != bands[x, :where]).all(axis=1))]
        if len(ys):
            est = sk.estimate((regs[x] > regs[ys]).sum(1), (regs[x] < regs[ys]).sum(1), n[x], n[ys])
            likely += [(e, int(x), int(y)) for e, y in zip(est, ys, strict=True) if e >= sk.margin(threshold)]
    return likely, comp


def _block_needs(threshold: float, percent: int):
    """One pair of blocks -> its sets that are in a likely pair: only their texts are fetched."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        likely, _ = _likely_pairs(key, table, threshold, percent)
        needed = pa.array(sorted({x for _, a, b in likely for x in (a, b)}), pa.int64())
        return table.select(["key", "i", "j", "chunk", "set_id", "component"]).take(needed)

    return run


def _block_links(threshold: float, size: int, percent: int):
    """One pair of blocks with texts -> links that join components, verified on full sets.

    Likeliest pairs come first, and a pair not at all once its components are joined:
    what leaves a task is at most one link for each of its sets.
    """

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        likely, comp = _likely_pairs(key, table, threshold, percent)
        likely.sort(key=lambda p: -p[0])
        n, ids, texts = table["n_shingles"].to_numpy(), table["set_id"].to_pylist(), table["text"]
        parent, cache, sets = list(range(int(comp.max()) + 1)), WordHashes(), {}

        def root(c: int) -> int:
            while parent[c] != c:
                parent[c] = c = parent[parent[c]]
            return c

        def full(x: int) -> np.ndarray:
            if x not in sets:
                sets[x] = shingles(texts[x].as_py(), size, cache)
            return sets[x]

        out_a, out_b = [], []
        for _, x, y in likely:
            p, q = root(comp[x]), root(comp[y])
            if p != q:
                both = len(np.intersect1d(full(x), full(y), assume_unique=True))
                if 100 * both >= percent * (n[x] + n[y] - both):
                    parent[p] = q
                    out_a.append(min(ids[x], ids[y]))
                    out_b.append(max(ids[x], ids[y]))
        return pa.table({"a": pa.array(out_a, pa.binary()), "b": pa.array(out_b, pa.binary())})

    return run


def _maybe_in(rows: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """The rows whose ``column`` is in ``values``, and a few others: what spares an exact join most of its shuffle, not the join.

    ``values`` is a staged table of one column of that name, without nulls. The
    filter is a bit a hash, broadcast as rows of 64 longs. It never holds more than
    FILTER_MOST bits: with more values than these are for, more other rows pass.
    """
    bits = min(FILTER_MOST, max(4096, 1 << (FILTER_BITS * values.count() - 1).bit_length()))
    at = F.pmod(F.xxhash64(column), F.lit(bits))
    longs = values.select(at.alias("at")).groupBy(F.expr("shiftright(at, 6) AS at")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 AS int))) AS long"))
    line = longs.groupBy(F.expr("shiftright(at, 6) AS line")).agg(F.expr("map_from_entries(collect_list(struct(at & 63 AS at, long))) AS longs"))
    line = line.select("line", F.expr("transform(sequence(0L, 63L), x -> coalesce(try_element_at(longs, x), 0L)) AS longs"))
    there = F.getbit(F.get("longs", F.shiftright(at, 6).bitwiseAND(63).cast("int")), at.bitwiseAND(63).cast("int")) == 1
    return rows.join(F.broadcast(line), (F.shiftright(at, 12) == F.col("line")) & there, "left_semi")


def _texts(set_ids: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """(set_id, text): one text for each of the set ids. Few other texts are shuffled."""
    keys = sets.select("set_id", "rep").join(set_ids.distinct(), "set_id").select("set_id", F.col("rep.doc_id").alias("doc_id"), F.col("rep.text_key").alias("text_key"))
    keys = stage(keys, "text-keys")
    # null doc_ids join too; rows repeated word for word give one text
    texts = _maybe_in(docs, keys.select("text_key"), "text_key").join(keys, docs.doc_id.eqNullSafe(keys.doc_id) & (docs.text_key == keys.text_key)).select("set_id", "text")
    return stage(texts.dropDuplicates(["set_id"]), "texts")


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Distinct pairs of set ids (a, b) -> those linked, by their full texts."""
    pairs = stage(pairs, "pairs")
    texts = _texts(pairs.select(F.col("a").alias("set_id")).union(pairs.select(F.col("b"))), sets, docs)
    a = texts.select(F.col("set_id").alias("a"), F.col("text").alias("a_text"))
    b = texts.select(F.col("set_id").alias("b"), F.col("text").alias("b_text"))
    joined = pairs.join(b, "b").join(a, "a").select("a", "b", "a_text", "b_text")
    return joined.mapInArrow(_verifier(size, percent), "a binary, b binary")


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, text_key, n_shingles, component_id, kept_key.

    Links two documents if 100 * |A and B| >= percent * |A or B| for their sets of
    distinct ``shingle_words``-word shingles. ``component_id`` is the smallest doc_id
    reachable; ``first_key`` is the text_key (xxhash64 of the text) of the component's
    representative row, which tells rows apart that repeat that doc_id.

    Copies fall together by the digest of their set before any pair is made. Bands
    of ROWS registers then bucket the distinct sets. A bucket's sets are dealt into
    SALTS parts, so that no key brings a bucket into one task: every set is compared
    with its part's least set, and these with the bucket's least: stars of stars,
    linear in the bucket. Buckets that still hold several components are compared
    across components in blocks of bounded size, by registers first; texts are only
    fetched for sets of likely pairs, and only joining links leave a block: no
    component is lost and no group is expanded into pairs.
    A pair at the threshold shares a band but for a chance of 3e-6.
    """
    threshold = percent / 100
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    sketch = stage(docs.mapInArrow(_sketcher(shingle_words), _SKETCH), "sketch")
    full = sketch.filter("set_id IS NOT NULL")
    rep = full.groupBy("set_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("regs").alias("regs"), F.first("bands").alias("bands"))
    sets = stage(rep, "sets")
    # most keys are of one set: these go before anything but the key is shuffled
    repeated = stage(sets.select(F.explode("bands").alias("key")).groupBy("key").count().filter("count > 1").select("key"), "repeated")
    keys = sets.select(F.explode("bands").alias("key"), F.pmod(F.xxhash64("set_id"), F.lit(SALTS)).cast("int").alias("salt"), "set_id", "n_shingles")
    keys = stage(_maybe_in(keys, repeated, "key"), "keys")
    parts = keys.groupBy("key", "salt").agg(F.min("set_id").alias("leader"), F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    whole = parts.groupBy("key").agg(F.min("leader").alias("head"), F.sum("n").alias("size"), F.sum("s").alias("shingles")).filter("size > 1")
    parts = stage(parts.select("key", "salt", "leader").join(whole, "key"), "parts")
    members = stage(keys.drop("n_shingles").join(parts, ["key", "salt"]), "members")

    star = members.filter("set_id <> leader").select(F.col("leader").alias("a"), F.col("set_id").alias("b"))
    star = star.union(parts.filter("leader <> head").select("head", "leader")).distinct()
    side = sets.select("set_id", "n_shingles", "regs")
    star = star.join(side.select(F.col("set_id").alias("b"), F.col("n_shingles").alias("b_n"), F.col("regs").alias("b_regs")), "b")
    star = star.join(side.select(F.col("set_id").alias("a"), F.col("n_shingles").alias("a_n"), F.col("regs").alias("a_regs")), "a")
    star = star.filter(100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n"))
    star = star.select("a", "b", "a_n", "b_n", "a_regs", "b_regs").mapInArrow(_likely(threshold), "a binary, b binary")
    links = stage(_verified(star, sets, docs, shingle_words, percent), "links")
    labels = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))

    # buckets of three and more whose sets the stars left in several components
    named = members.filter("size > 2").join(labels, members.set_id == labels.node, "left")
    open_sets = stage(named.select("key", "salt", "size", "shingles", "set_id", F.coalesce("component", "set_id").alias("component")), "open")
    ends = open_sets.groupBy("key", "salt").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    unresolved = ends.groupBy("key").agg(F.min("low").alias("lowest"), F.max("high").alias("highest")).filter("lowest <> highest").select("key")
    rest = stage(open_sets.join(ends.select("key", "salt").join(unresolved, "key"), ["key", "salt"]), "unresolved")
    if not rest.isEmpty():
        blocks = rest.withColumn("n_chunks", F.ceil(F.greatest(F.col("size") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int"))
        blocks = blocks.withColumn("chunk", F.pmod(F.xxhash64("set_id", F.lit(1)), F.col("n_chunks")).cast("int"))
        blocks = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)))
        blocks = blocks.select("key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "set_id", "component").distinct()
        sketches = sets.select("set_id", "n_shingles", "regs", "bands")
        found = blocks.join(sketches, "set_id").groupBy("key", "i", "j").applyInArrow(_block_needs(threshold, percent), blocks.schema)
        needed = stage(found, "needed")
        whole = needed.join(sketches, "set_id").join(_texts(needed.select("set_id"), sets, docs), "set_id")
        more = whole.groupBy("key", "i", "j").applyInArrow(_block_links(threshold, shingle_words, percent), "a binary, b binary")
        links = links.union(stage(more, "links"))
        labels = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))

    named = sets.select("set_id", "rep").join(labels, sets.set_id == labels.node, "left").select("set_id", "rep", F.coalesce("component", "set_id").alias("component"))
    first = named.groupBy("component").agg(F.min("rep").alias("first"))
    named = named.join(first, "component").select("set_id", "first")
    linked = full.select("doc_id", "text_key", "n_shingles", "set_id").join(named, "set_id").select("doc_id", "text_key", "n_shingles", F.col("first.doc_id").alias("component_id"), F.col("first.text_key").alias("first_key"))
    alone = sketch.filter("set_id IS NULL").select("doc_id", "text_key", "n_shingles", F.col("doc_id").alias("component_id"), F.col("text_key").alias("first_key"))
    return linked.unionByName(alone)


def keep_first(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stay: one row of each group, all columns; documents without words stay."""
    plan = near_duplicates(docs, shingle_words, percent)
    stays = plan.filter(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_key") == F.col("first_key")))
    stays = stays.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    # rows without words are never copies of each other
    alone = F.when(F.col("text").rlike(WORD), F.lit(0)).otherwise(F.monotonically_increasing_id() + 1)
    keyed = docs.withColumn("__text_key", F.xxhash64("text")).withColumn("__alone", alone)
    kept = keyed.join(stays, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text_key") == F.col("__key")), "left_semi")
    return kept.dropDuplicates(["doc_id", "__text_key", "__alone"]).select(*[f"`{c}`" for c in docs.columns])


def op3(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle_words=4)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
