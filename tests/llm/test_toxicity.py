import math
from collections import Counter

import numpy as np
import pytest

from postwright.llm import toxicity as T
from tests.llm.fixtures import documents, no_documents, prose

BAD = ["rotten", "vile", "scoundrel", "wretch"]


def corpus(n=400):
    rows, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        text = prose(1000 + i, 60)
        if bad:
            text += " " + BAD[i % 4] + " " + BAD[(i // 5) % 4] + " " + BAD[(i + 1) % 4]
        rows.append((i, text))
        if i % 2 == 0:
            labels.append((i, int(bad)))
    return rows, labels


def test_held_out_documents(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows + [(900, None), (901, ""), (None, "rotten vile wretch")], "doc_id long, text string")
    found = {r["doc_id"]: r for r in T.score(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert len(found) == len(rows) + 3
    right = sum((found[i]["score"] >= T.THRESHOLD) == (i % 5 == 0) for i, _ in rows if i % 2)
    assert right >= 0.98 * sum(1 for i, _ in rows if i % 2)
    assert found[None]["score"] >= T.THRESHOLD and found[900]["score"] == found[901]["score"] < T.THRESHOLD
    assert all(0 <= r["score"] <= 1 for r in found.values())
    assert all(e["doc_id"] % 2 == 0 for r in found.values() for e in r["evidence"])


def test_labels_of_the_held_out_fold_teach_nothing(spark):
    rows, labels = corpus(200)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    from pyspark.sql import functions as F

    teach = F.col("doc_id") % 4 != 2
    a = T.score(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), teach)
    b = T.score(docs, spark.createDataFrame([(i, 1 - t if i % 4 == 2 else t) for i, t in labels], "doc_id long, toxic int"), teach)
    assert sorted(a.select("doc_id", "score").collect()) == sorted(b.select("doc_id", "score").collect())


def test_the_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(T, "MAX_LABELLED", 60)
    rows, labels = corpus()
    model, counted = T.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert 0 < len(model.ids) <= 60 and counted.count() == len(rows)


def test_neighbours_are_exact():
    rng = np.random.default_rng(3)
    model = T.Model(terms={f"t{i}": i for i in range(40)}, idf=rng.random(40) + 1)
    examples = [(i, int(i % 3 == 0), sorted({int(t): int(c) for t, c in zip(rng.integers(0, 40, 6), rng.integers(1, 4, 6), strict=True)}.items())) for i in range(500)]
    T.build_index(model, examples)
    vectors = {}
    for doc, _, pairs in examples:
        index, w = T.vector(model, pairs)
        vectors[doc] = np.zeros(40)
        vectors[doc][index] = w
    for _, _, pairs in examples[:60]:
        index, w = T.vector(model, pairs)
        q = np.zeros(40)
        q[index] = w
        every = sorted((-round(float(q @ vectors[int(d)]), 12), k) for k, d in enumerate(model.ids))[: T.NEIGHBOURS]
        assert [(-s, k) for s, k in every if s < -1e-9] == T.nearest(model, index, w)


def test_filter_and_edge_cases(spark):
    rows, labels = corpus(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(labels + [(2, None), (None, 1), (10, 0)], "doc_id long, toxic int")
    kept = {r["doc_id"] for r in T.without_toxic(docs, labels).collect()}
    assert sum(i in kept for i, _ in rows if i % 5 == 0) <= 2 and sum(i not in kept for i, _ in rows if i % 5) <= 4
    none = labels.limit(0)
    assert {r["score"] for r in T.score(docs, none).collect()} == {0.0}
    assert T.score(no_documents(spark), labels).count() == 0
    extra = documents(spark)
    assert T.without_toxic(extra, none).columns == extra.columns and T.without_toxic(extra, none).count() == extra.count()


def test_copies_of_examples_without_a_telling_word(spark):
    rows, labels = corpus()
    odd, clean = prose(7001, 80), prose(7002, 80)
    rows += [(2000, odd), (2001, odd), (2002, odd + " end"), (2004, clean), (2005, clean), (2007, None)]
    labels += [(2000, 1), (2004, 0)]
    found = {r["doc_id"]: r for r in T.score(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert not set(T.tokens(odd)) & set(BAD)
    assert all(found[i]["score"] >= T.THRESHOLD and found[i]["evidence"][0]["doc_id"] == 2000 for i in (2000, 2001, 2002))
    assert found[2001]["evidence"][0]["similarity"] == 1 and found[2001]["score"] == found[2000]["score"]
    assert found[2005]["score"] < T.THRESHOLD and found[2005]["evidence"][0] == (2004, 1.0) and found[2007]["evidence"] == []
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in T.without_toxic(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert not kept & {2000, 2001, 2002} and {2004, 2005, 2007} <= kept


def brute_neighbours(own, ids, near):
    """Per bag of (words, counts): (similarity, id) of all bags from ``near`` on, nearest first, smaller ids first."""
    words = np.unique(np.concatenate([x for x, _ in own]))
    df = np.array([sum(w in x for x, _ in own) for w in words])
    full = np.zeros((len(own), len(words)))
    for i, (x, c) in enumerate(own):
        at = np.searchsorted(words, x)
        full[i, at] = (1 + np.log(c)) * (np.log((1 + len(own)) / (1 + df[at])) + 1)
    full /= np.linalg.norm(full, axis=1, keepdims=True)
    sims = np.round(full @ full.T, 5)
    return words, df, [sorted(((-s, i) for s, i in zip(row, ids, strict=True) if s >= near))[: T.NEIGHBOURS] for row in sims]


def index_of(own, ids, words, df):
    idf = np.log((1 + len(own)) / (1 + df)) + 1
    sizes = np.array([len(x) for x, _ in own])
    word, w = T.weigh(np.concatenate([x for x, _ in own]), np.concatenate([c for _, c in own]), sizes, words, idf)
    return T.build_whole(ids, np.zeros(len(own)), sizes, word, w, words, idf, len(own))


@pytest.mark.parametrize(("head", "rare"), [(8, 5), (8, 10**6), (0, 0), (10**6, 0)])
def test_neighbours_over_all_words_are_exact(monkeypatch, head, rare):
    monkeypatch.setattr(T, "HEAD", head)
    monkeypatch.setattr(T, "RARE", rare)
    monkeypatch.setattr(T, "BLOCK", 16)
    rng = np.random.default_rng(5)
    bags = [np.minimum(rng.zipf(1.3, 40), 500).astype(np.int64) * 7919 for _ in range(300)]
    bags += bags[:9]  # copies: ties
    own = [np.unique(b, return_counts=True) for b in bags]
    ids = rng.permutation(len(own))
    words, df, want = brute_neighbours(own, ids, T.NEAR)
    whole, seen = index_of(own, ids, words, df), 0
    for found, expected in zip(T.nearest_whole(whole, own), want, strict=True):
        got = [(-round(float(s), 5), int(whole.ids[i])) for i, s in zip(*found, strict=True)]
        assert [i for _, i in got[:2]] == [i for _, i in expected[:2]] and np.allclose([s for s, _ in got], [s for s, _ in expected], atol=2e-5)
        seen += len(got)
    assert seen > 2 * len(own)


def test_scores_of_the_query_from_brute_force(spark, monkeypatch):
    """The evidence and whole-word votes of every document, from all pairs."""
    rows, labels = corpus(120)
    rows += [(500 + i, rows[i][1] + " tail") for i in range(0, 40, 3)] + [(600, rows[10][1]), (601, rows[10][1])]
    docs, marked = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    found = {r["doc_id"]: r for r in T.score(docs, marked).collect()}
    toxic, bags = dict(labels), [Counter(T.tokens(t)) for _, t in rows]
    df, n = Counter(w for b in bags for w in b), len(rows)
    taught = set().union(*(bags[i] for i, (d, _) in enumerate(rows) if d in toxic))
    weigh = lambda b: {w: (1 + math.log(c)) * (math.log((1 + n) / (1 + (df[w] if w in taught else 1))) + 1) for w, c in b.items()}
    vectors = [weigh(b) for b in bags]
    norms = [math.sqrt(sum(x * x for x in v.values())) for v in vectors]
    for i, (doc, _) in enumerate(rows):
        near = []
        for j, (d, _) in enumerate(rows):
            s = sum(x * vectors[j].get(w, 0) for w, x in vectors[i].items()) / norms[i] / norms[j]
            if d in toxic and s >= T.NEAR:
                near.append((-round(s, 5), d))
        near = sorted(near)[: T.NEIGHBOURS]
        assert [e["doc_id"] for e in found[doc]["evidence"]] == [d for _, d in near[:3]]
        vote = sum((-s) ** T.POWER * toxic[d] for s, d in near) / (sum((-s) ** T.POWER for s, _ in near) + 1)
        assert found[doc]["score"] >= vote - 1e-3
    assert found[600]["score"] == found[601]["score"]


def test_a_task_holds_the_model_once():
    import tracemalloc

    model = T.Model(terms={"a": 0, "ß": 1}, labels=np.random.default_rng(1).random(1 << 20), tiles=[np.eye(3), np.zeros((2, 0))])
    held = [T.packed(model)]
    tracemalloc.start()
    got = T.unpacked(held)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert not held and got.terms == model.terms and (got.labels == model.labels).all() and [t.tolist() for t in got.tiles] == [t.tolist() for t in model.tiles]
    assert peak < 1.5 * model.labels.nbytes


def test_the_filter_sends_no_texts_to_python(spark):
    docs = spark.createDataFrame([(1, "x", "a b"), (2, None, None)], "doc_id long, `a.b` string, text string")
    kept = docs.filter(T._filter(T.packed(T.Model()))(T._hashes("text")))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert kept.collect() == docs.collect() and "ArrowEvalPython" in plan and "MapInArrow" not in plan


def test_the_filter_gets_the_model_without_a_packed_copy(spark, monkeypatch):
    rows, labels = corpus(120)
    docs, marked = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    want = {r["doc_id"] for r in T.score(docs, marked).collect() if r["score"] < T.THRESHOLD}

    def refuse(_):
        raise AssertionError("a packed copy stays in each worker")

    monkeypatch.setattr(T, "packed", refuse)
    kept = T.without_toxic(docs, marked)
    assert 0 < len(want) < len(rows) and {r["doc_id"] for r in kept.collect()} == want


def test_the_filter_makes_a_worker_drop_what_it_keeps():
    import weakref

    import public_tokenizers
    import pyarrow as pa

    from postwright.llm import packing

    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = packing.encoder(path)
    encoder(["some words"])
    assert packing.encoder(path) is encoder
    gone = weakref.ref(encoder)
    del encoder
    assert gone() is not None
    run = T._filter(T.packed(T.Model())).func
    assert [x.to_pylist() for x in run(iter([pa.array([[1, 2], []], pa.list_(pa.int64()))]))] == [[True, True]]
    assert gone() is None
