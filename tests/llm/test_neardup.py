from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from postwright.llm import neardup
from postwright.llm import setsketch as sk
from postwright.llm.components import connected_components
from tests.llm.fixtures import ROWS, documents, no_documents


def shingle_sets(size):
    out = []
    for doc, text in ROWS:
        words = (text or "").encode().lower().split()
        out.append((doc, {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()))
    return out


def brute_force(size, percent=80):
    """(doc_id, n_shingles, component id) of every row, by all pairs."""
    sets = shingle_sets(size)
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    out = []
    for i, (doc, s) in enumerate(sets):
        ids = [sets[j][0] for j in range(len(sets)) if root(j) == root(i) and sets[j][0] is not None]
        out.append((doc, len(s), min(ids) if ids and s else doc if not s else None))
    return Counter(out)


@pytest.mark.parametrize("size", [4, 5])
def test_matches_all_pairs(spark, size):
    found = neardup.near_duplicates(documents(spark), size).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == brute_force(size)


def test_unresolved_buckets_lose_no_link(spark):
    # a chain: each text is close to the next, the ends are far apart
    base = [f"w{i}" for i in range(300)]
    rows = [(k, " ".join([f"n{i}" if i < 12 * k else w for i, w in enumerate(base)])) for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs, 4).collect()}
    assert set(found.values()) == {0}


def test_pairs_just_above_the_threshold_are_found(spark):
    # pairs of texts without any word in common with others; one word in the middle costs four shingles
    rows, wanted = [], {}
    for k in range(300):
        words = [f"p{k}w{i}" for i in range(60 + k % 50)]
        other = list(words)
        for c in range(k % 3 + 1):
            other[10 + 13 * c] = f"new{k}x{c}"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        a, b = ({tuple(t[i : i + 4]) for i in range(len(t) - 3)} for t in (words, other))
        wanted[2 * k + 1] = 2 * k if 100 * len(a & b) >= 80 * len(a | b) else 2 * k + 1
        if k % 2:  # both sides of the threshold stand near it
            assert 0.6 < len(a & b) / len(a | b) < 0.95
    found = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()}
    assert {d: found[d] for d in wanted} == wanted


def test_a_large_bucket_is_dealt_into_parts_and_blocks(spark, monkeypatch):
    # one long common text, changed at its end in another way each time: all sets share most bands
    monkeypatch.setattr(neardup, "BLOCK", 8)
    base = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join(base[:180] + [f"e{k}x{i}" for i in range(k % 2 * 60)] + [f"t{k}"])) for k in range(60)]
    found = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()}
    sets = {k: {tuple(t.split()[i : i + 4]) for i in range(len(t.split()) - 3)} for k, t in rows}
    near = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    assert all(found[k] == 0 for k in range(0, 60, 2)) and all(near(a, 0) == (found[a] == 0) for a in range(1, 60))


def test_keep_first_keeps_one_of_each(spark):
    docs = documents(spark)
    kept = neardup.keep_first(docs, 5)
    assert kept.columns == docs.columns
    ids = Counter(r["doc_id"] for r in kept.select("doc_id").collect())
    groups = {c for _, n, c in brute_force(5) if n}
    assert {i for i in ids if i is not None} == {g for g in groups if g is not None} | {7, 8, 9}
    assert ids[15] == 1 and ids[None] == 1


def test_texts_and_keys_of_one_set_are_not_shuffled(spark):
    # long texts without a common word, but for ten pairs: more than the texts themselves was shuffled before
    rng = np.random.default_rng(4)
    rows = [(k, " ".join(map(str, rng.integers(0, 2**62, 400)))) for k in range(390)]
    rows += [(1000 + k, rows[k][1] + " more") for k in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()

    before = shuffled()
    found = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs, 4).collect()}
    assert found == {k: k for k in range(390)} | {1000 + k: k for k in range(10)}
    assert shuffled() - before < 0.4 * sum(len(text) for _, text in rows)


@pytest.mark.parametrize("most", [4096, 1 << 28])
def test_filter_loses_no_value(spark, monkeypatch, most):
    monkeypatch.setattr(neardup, "FILTER_MOST", most)
    rows = spark.range(-20000, 20000).select((F.col("id") * 7919 * 2**32).alias("key"), "id")
    found = {r["id"] for r in neardup._maybe_in(rows, rows.filter("id % 20 = 0").select("key"), "key").collect()}
    assert found >= set(range(-20000, 20000, 20)) and len(found) < (40000 if most == 4096 else 6000)
    assert neardup._maybe_in(rows, rows.filter("id > 20000").select("key"), "key").count() == 0


def test_repeated_rows_without_words_all_stay(spark):
    docs = spark.createDataFrame([(1, " "), (1, " "), (2, None), (2, None), (3, "a b"), (3, "a b")], "doc_id long, text string")
    assert Counter(r["doc_id"] for r in neardup.keep_first(docs).collect()) == {1: 2, 2: 2, 3: 1}


def test_empty_table(spark):
    assert neardup.near_duplicates(no_documents(spark)).count() == 0
    assert neardup.keep_first(no_documents(spark)).count() == 0


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = x[:2000], x[500:2500]
    ra, rb = sk.registers(a), sk.registers(b)
    assert (sk.merge(ra, rb) == sk.registers(np.union1d(a, b))).all()
    est = sk.estimate([(ra > rb).sum()], [(ra < rb).sum()], np.array([2000]), np.array([2000]))[0]
    assert abs(est - 0.6) < 0.2


def test_components_of_paths(spark):
    edges = spark.createDataFrame([(f"{(i * 7919) % 1009:04d}", f"{((i + 1) * 7919) % 1009:04d}") for i in range(60)] + [("x", "y"), ("z", "z")], "u string, v string")
    found = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    names = [f"{(i * 7919) % 1009:04d}" for i in range(61)]
    assert {found[n] for n in names} == {min(names)} and found["y"] == "x" and "z" not in found
