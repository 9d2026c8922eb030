import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from postwright.llm import gru, lm
from postwright.llm.common import held_out
from tests.llm.fixtures import ROWS, documents, no_documents


def base(rows):
    """n_tokens, n_known, training tokens and base score of each row, by the definition."""
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows]
    tokens = [[*(t or "").encode().lower().split(), None] for _, t in rows]
    counts = Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
    n, v = sum(counts.values()), len(counts)
    out = []
    for (doc, _), t, h in zip(rows, tokens, held, strict=True):
        score = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t)
        out.append((doc, h, len(t), sum(counts[w] > 0 for w in t), n, round(score, 6)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("frequent", [lm.FREQUENT, 20])
def test_base_scores(spark, monkeypatch, frequent):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    found = lm.score(documents(spark), held_out(F.col("doc_id"), 7, 2)).collect()
    got = [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found]
    assert sorted(got, key=repr) == base(ROWS)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in found)


def test_empty_tables(spark):
    assert lm.score(no_documents(spark), F.lit(False)).count() == 0
    unseen = lm.score(documents(spark), F.lit(True)).collect()
    assert len(unseen) == len(ROWS) and all(r["train_tokens"] == 0 and r["n_known"] == 0 and math.isfinite(r["score"]) for r in unseen)


def test_scores_do_not_depend_on_the_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD", 20_000)
    monkeypatch.setattr(lm, "SUMMED", 2)
    monkeypatch.setattr(lm, "START_DOCS", 5)
    docs, held = documents(spark), held_out(F.col("doc_id"), 7, 2)
    one, six = (sorted((str(r["doc_id"]), r["n_tokens"], r["score"]) for r in lm.score(docs.repartition(n), held).collect()) for n in (1, 6))
    assert [x[:2] for x in one] == [x[:2] for x in six]
    assert np.allclose([x[2] for x in one], [x[2] for x in six], rtol=1e-4)
    again = {}
    for d, _, x in one:
        again.setdefault(d, []).append(x)
    assert all(max(x) - min(x) <= 1e-4 * abs(x[0]) for d, x in again.items() if d != "None" and len(x) > 1)


def test_the_vocabulary_grows():
    assert [lm.classes_for(n) for n in (0, 10**6, 10**8, 10**10)] == [32, 32, 100, 316]
    assert lm._symbols(gru.vocabulary(100)) is np.uint16 and lm._symbols(gru.vocabulary(316)) is np.uint32


def sequences(n, seed):
    """Two languages of words that follow each other: context helps."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        first = int(rng.integers(0, 2)) * 100 + 2
        out.append(np.append(first + rng.integers(0, 60, int(rng.integers(5, 60))), gru.END).astype(np.int32))
    return out


def test_training_beats_the_start():
    train, test = sequences(300, 1), sequences(60, 2)
    counts = np.bincount(np.concatenate(train), minlength=gru.vocabulary(32)).astype(float)
    start = gru.start(counts, 32)
    trainer = gru.Trainer(start, 0.02)
    for _ in range(6):
        trainer.learn(train)
    tokens = sum(map(len, test))
    before, after = gru.log_likelihoods(start, test).sum() / tokens, gru.log_likelihoods(trainer.p, test).sum() / tokens
    assert after > before + 0.3


def test_a_documents_score_does_not_depend_on_its_neighbours():
    docs = sequences(40, 5)
    p = gru.start(np.ones(gru.vocabulary(32)), 32)
    together = gru.log_likelihoods(p, docs)
    alone = [gru.log_likelihoods(p, [d])[0] for d in docs]
    assert np.allclose(together, alone, rtol=1e-4)


def test_probabilities_sum_to_one():
    p = gru.start(np.random.default_rng(0).random(gru.vocabulary(32)) * 50, 32)
    docs = [np.array([7, w], np.int32) for w in range(gru.vocabulary(32))]
    one = gru.log_likelihoods(p, [np.array([7], np.int32)])[0]
    assert abs(np.exp(gru.log_likelihoods(p, docs) - one).sum() - 1) < 1e-3


def test_gradients():
    """Backpropagation against differences of the loss, over one window."""
    rng = np.random.default_rng(4)
    p = {k: v.astype(np.float64) for k, v in gru.start(np.ones(gru.vocabulary(32)), 32).items()}
    docs = [rng.integers(0, 200, gru.WINDOW).astype(np.int32)]
    caught = {}

    class Catch(gru.Trainer):
        def _step(self, grads, n):
            caught.update(grads)

    Catch(p, 0.1).learn(docs)
    for name, at in (("u", (3, 7)), ("u", (2, 40)), ("w", (1, 20)), ("b", (35,)), ("class_w", (4, 2))):
        for sign in (1, -1):
            q = {k: v.copy() for k, v in p.items()}
            q[name][at] += sign * 1e-2
            caught[sign] = -gru.log_likelihoods(q, docs)[0]
        assert abs((caught[1] - caught[-1]) / 2e-2 - caught[name][at]) < 2e-2 * max(1, abs(caught[name][at]))


def test_logits_of_all_classes_are_normalised_together(monkeypatch):
    calls, softmax = [], gru._softmax
    monkeypatch.setattr(gru, "_softmax", lambda *a: calls.append(1) or softmax(*a))
    p, rng = gru.start(np.ones(gru.vocabulary(32)), 32), np.random.default_rng(5)
    gru.Trainer(p, 0.01).learn([rng.integers(0, gru.vocabulary(32), gru.WINDOW).astype(np.int32)])
    assert len(calls) == 3  # the classes, their words, and the special symbols


def test_large_logits_and_missing_symbols():
    p, rng = gru.start(np.ones(gru.vocabulary(32)), 32), np.random.default_rng(6)
    h = rng.uniform(-1, 1, (40, gru.HIDDEN)).astype(np.float32)
    for scale in (1, 300):
        q = {k: (v * scale).astype(np.float32) if k in ("class_w", "word_w", "word_b", "special_b") else v for k, v in p.items()}
        for target in (rng.integers(0, gru.vocabulary(32), 40), np.arange(40) % 2, np.arange(2, 42)):
            got, grads, back = gru._output(q, h, target, True)
            for i, t in enumerate(target):
                c, w = (0, t) if t < gru.SPECIAL else (1 + (t - gru.SPECIAL) // 32, (t - gru.SPECIAL) % 32)
                logits = [h[i] @ q["class_w"] + q["class_b"], h[i] @ q["word_w"][c - 1] + q["word_b"][c - 1] if c else h[i] @ q["special_w"] + q["special_b"]]
                want = sum(float(x[j] - x.max() - np.log(np.exp(x.astype(float) - x.max()).sum())) for x, j in zip(logits, (c, w), strict=True))
                assert abs(got[i] - want) <= 1e-4 * max(1, abs(want))
            assert np.isfinite(back).all() and all(np.isfinite(g).all() and g.shape == q[k].shape for k, g in grads.items())
