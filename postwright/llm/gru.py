"""A gated recurrent language model in numpy: truncated backpropagation, class-factored softmax, carried state.

Words are numbered by frequency and dealt into classes of equal size, about as many
classes as words in a class; a word's probability is its class's times its own
within the class. The first class holds the end of a document and the symbol of all
words outside the vocabulary. Documents run in parallel lanes, one after another in
a lane; the state is carried from window to window of a document and cleared
where a document starts, so a document's log-likelihood is that of its whole text.
"""

from __future__ import annotations

import heapq

import numpy as np

HIDDEN, WINDOW = 16, 16
#: Symbols: the end of a document (also the input before its first word), and any word outside the vocabulary.
END, OTHER, SPECIAL = 0, 1, 2
MAX_LANES = 1024
#: Tokens that are scored together, about; and logits whose exponentials and their sums are surely numbers of single precision lie within FAR of 0.
SCORED, FAR = 1 << 15, 60.0


def shapes(classes: int) -> dict[str, tuple[int, ...]]:
    """Parameters of a network with ``classes`` classes of ``classes`` words each, and the special class."""
    c, k = classes, HIDDEN
    return {
        "embed": (vocabulary(c), k), "w": (k, 3 * k), "u": (k, 3 * k), "b": (3 * k,), "class_w": (k, c + 1), "class_b": (c + 1,),
        "special_w": (k, SPECIAL), "special_b": (SPECIAL,), "word_w": (c, k, c), "word_b": (c, c),
    }


def vocabulary(classes: int) -> int:
    """Symbols: the special ones and the words."""
    return SPECIAL + classes * classes


def start(counts: np.ndarray, classes: int) -> dict[str, np.ndarray]:
    """First parameters: small random weights, and biases that give the symbols' relative frequencies."""
    rng = np.random.Generator(np.random.PCG64(11))
    p = {k: (rng.standard_normal(s) * (0.5 if k == "embed" else 0.25)).astype(np.float32) for k, s in shapes(classes).items()}
    words, special = (counts[SPECIAL:] + 0.5).reshape(classes, classes), counts[:SPECIAL] + 0.5
    per_class = np.concatenate([[special.sum()], words.sum(1)])
    p["b"][:] = 0
    p["class_b"] = np.log(per_class / per_class.sum()).astype(np.float32)
    p["special_b"] = np.log(special / special.sum()).astype(np.float32)
    p["word_b"] = np.log(words / words.sum(1, keepdims=True)).astype(np.float32)
    for k in ("class_w", "word_w", "special_w"):
        p[k] *= 0.2
    return p


def flatten(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in shapes(len(p["word_b"]))])


def restore(flat: np.ndarray, classes: int) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, shape in shapes(classes).items():
        n = int(np.prod(shape))
        out[k], at = np.array(flat[at : at + n], np.float32).reshape(shape), at + n
    return out


def lanes(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents (symbols with their END) -> inputs, targets (-1: none) and the owner of each target, as steps x lanes.

    Lanes are about as long as the longest document, which keeps them all busy.
    """
    sizes = np.array([len(d) for d in docs])
    n = int(np.clip(sizes.sum() // max(1, sizes.max()), 1, MAX_LANES))
    heap, queues = [(0, i) for i in range(n)], [[] for _ in range(n)]
    for k in np.argsort(-sizes, kind="stable"):
        load, i = heapq.heappop(heap)
        queues[i].append(int(k))
        heapq.heappush(heap, (load + int(sizes[k]), i))
    steps = max(load for load, _ in heap)
    steps += -steps % WINDOW
    target, owner = np.full((steps, n), -1, np.int32), np.full((steps, n), -1, np.int32)
    source = np.zeros((steps, n), np.int32)
    for i, queue in enumerate(queues):
        at = 0
        for k in queue:
            d = docs[k]
            target[at : at + len(d), i] = d
            owner[at : at + len(d), i] = k
            source[at, i] = END
            source[at + 1 : at + len(d), i] = d[:-1]
            at += len(d)
    return source, target, owner


def _inputs(p: dict, x: np.ndarray) -> np.ndarray:
    """Embeddings (steps x lanes x H) -> their input sums, steps x 3H x lanes: what is done to all lanes lies side by side."""
    return np.matmul(p["w"].T, x.transpose(0, 2, 1)) + p["b"][:, None]


def _recur(p: dict, x: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: bool) -> tuple[np.ndarray, tuple | None]:
    """x: steps x 3H x lanes input sums. Returns all states (the first is ``h``) and what backpropagation needs: r and z, what r lets through, c."""
    k, steps, n = HIDDEN, len(x), x.shape[2]
    out, held = np.empty((steps + 1, k, n), np.float32), steps if keep else 1
    out[0] = h
    # gates are 1 / (1 + exp(-sum)): their sums come with the sign changed
    u, to_gates = p["u"].T.copy(), -x[:, : 2 * k]
    u[: 2 * k] *= -1
    kept = np.empty((held, 2 * k, n), np.float32), np.empty((held, k, n), np.float32), np.empty((held, k, n), np.float32)
    for t in range(steps):
        gates, inner, c = (a[t if keep else 0] for a in kept)
        old = out[t] * fresh[t]
        sums = u @ old
        np.add(sums[: 2 * k], to_gates[t], out=gates, casting="same_kind")
        np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        inner[:] = sums[2 * k :]
        np.multiply(gates[:k], inner, out=c)
        c += x[t, 2 * k :]
        np.tanh(c, out=c)
        np.subtract(old, c, out=out[t + 1])
        out[t + 1] *= gates[k:]
        out[t + 1] += c
    return out, kept if keep else None


def _softmax(x: np.ndarray, target: np.ndarray, far: bool, learn: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Logits, which are overwritten -> log-probabilities of the targets, and the gradient of their negative sum by the logits. ``far``: they may have exponentials beyond their type."""
    if far:
        x -= x.max(axis=1, keepdims=True)
    rows = np.arange(len(target))
    own = x[rows, target]
    np.exp(x, out=x)
    total = x @ np.ones(x.shape[1], x.dtype)
    logs = own - np.log(total)
    if not learn:
        return logs, None
    x *= np.reciprocal(total)[:, None]
    x[rows, target] -= 1
    return logs, x


def _weights(w: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, bool]:
    """Weights with their biases as a last row, and whether logits may be far from 0: states lie between -1 and 1."""
    whole = np.concatenate([w, b[..., None, :]], axis=-2)
    return whole, bool(np.abs(whole).sum(axis=-2).max() > FAR)


def _output(p: dict, h: np.ndarray, target: np.ndarray, learn: bool) -> tuple[np.ndarray, dict | None, np.ndarray | None]:
    """States and targets -> natural log-probabilities, and the gradients of their negative sum."""
    size, k = p["word_b"].shape[1], HIDDEN
    cls = np.where(target < SPECIAL, 0, (target - SPECIAL) // size + 1)
    # targets class by class: each class is a slice
    order = np.argsort(cls.astype(np.int16 if size < 1 << 15 else np.int64), kind="stable")
    target, cls = target[order], cls[order]
    h = np.concatenate([h[order], np.ones((len(order), 1), h.dtype)], axis=1)
    edges = np.searchsorted(cls, np.arange(len(p["class_b"]) + 1)).tolist()
    within = np.where(target < SPECIAL, target, (target - SPECIAL) % size)
    of_class, far = _weights(p["class_w"], p["class_b"])
    special, special_far = _weights(p["special_w"], p["special_b"])
    of_word, word_far = _weights(p["word_w"], p["word_b"])
    total, d = _softmax(h @ of_class, cls, far, learn)
    # each class's logits in its rows; the special class has fewer
    x = np.empty((len(target), size), np.result_type(h, of_word))
    slices = [(c, slice(a, b)) for c, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if c and a < b]
    rest = edges[1]
    for c, part in slices:
        np.matmul(h[part], of_word[c - 1], out=x[part])
    logs, d_word = _softmax(x[rest:], within[rest:], word_far, learn)
    total[rest:] += logs
    logs, d_special = _softmax(h[:rest] @ special, within[:rest], special_far, learn)
    total[:rest] += logs
    grads = back = None
    if learn:
        g_word, dh = np.zeros_like(of_word), d @ p["class_w"].T
        dh[:rest] += d_special @ p["special_w"].T
        for c, part in slices:
            np.matmul(h[part].T, x[part], out=g_word[c - 1])
            dh[part] += x[part] @ of_word[c - 1, :k].T
        parts = (("class", h.T @ d), ("special", h[:rest].T @ d_special), ("word", g_word))
        grads = {f"{name}_{kind}": np.ascontiguousarray(g[..., :k, :] if kind == "w" else g[..., k, :]) for name, g in parts for kind in "wb"}
        back = np.empty_like(dh)
        back[order] = dh
    ordered = np.empty_like(total)
    ordered[order] = total
    return ordered, grads, back


def log_likelihoods(p: dict, docs: list[np.ndarray]) -> np.ndarray:
    """Natural log-likelihood of each document (symbols with their END), state carried across windows."""
    source, target, owner = lanes(docs)
    sums, h = np.zeros(len(docs)), np.zeros((HIDDEN, source.shape[1]), np.float32)
    first = np.ones(target.shape, bool)
    first[1:] = owner[1:] != owner[:-1]
    # words of several windows are looked at together
    step = WINDOW * max(1, SCORED // (WINDOW * source.shape[1]))
    for at in range(0, len(source), step):
        part = slice(at, at + step)
        states, _ = _recur(p, _inputs(p, p["embed"][source[part]]), (~first[part]).astype(np.float32), h, False)
        h, real = states[-1], target[part] >= 0
        logs, _, _ = _output(p, states[1:].transpose(0, 2, 1)[real], target[part][real], False)
        sums += np.bincount(owner[part][real], weights=logs, minlength=len(docs))
    return sums


class Trainer:
    """Adam over windows of truncated backpropagation through time."""

    def __init__(self, p: dict[str, np.ndarray], rate: float) -> None:
        self.p, self.rate, self.t = {k: v.copy() for k, v in p.items()}, rate, 0
        self.m, self.v = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))

    def learn(self, docs: list[np.ndarray]) -> None:
        p, k = self.p, HIDDEN
        source, target, owner = lanes(docs)
        first = np.ones(target.shape, bool)
        first[1:] = owner[1:] != owner[:-1]
        h = np.zeros((k, source.shape[1]), np.float32)
        for at in range(0, len(source), WINDOW):
            part = slice(at, at + WINDOW)
            ids, real, fresh = source[part], target[part] >= 0, (~first[part]).astype(np.float32)
            x = p["embed"][ids]
            states, (gates, inner, c) = _recur(p, _inputs(p, x), fresh, h, True)
            _, grads, dh = _output(p, states[1:].transpose(0, 2, 1)[real], target[part][real], True)
            flow = np.zeros((*ids.shape, k), np.float32)
            flow[real] = dh
            flow = flow.transpose(0, 2, 1).copy()
            # all that doesn't depend on later steps, of all steps at once
            old, r, z = states[:-1] * fresh[:, None, :], gates[:, :k], gates[:, k:]
            stays = 1 - z
            to_c = (1 - c * c) * stays
            to_r, to_z, on = inner * r * (1 - r), (old - c) * z * stays, z * fresh[:, None, :]
            through, inside, back = np.empty((len(ids), 3 * k, ids.shape[1]), np.float32), np.empty_like(c), None
            for t in range(len(ids) - 1, -1, -1):
                g, own, dc = flow[t], through[t], inside[t]  # own: what goes back into the last state
                if back is not None:
                    g += back
                np.multiply(g, to_c[t], out=dc)
                np.multiply(dc, to_r[t], out=own[:k])
                np.multiply(g, to_z[t], out=own[k : 2 * k])
                np.multiply(dc, r[t], out=own[2 * k :])
                back = p["u"] @ own
                back *= fresh[t]
                back += g * on[t]
            du = np.matmul(old, through.transpose(0, 2, 1)).sum(0)
            through[:, 2 * k :] = inside
            flat, xs = through.transpose(0, 2, 1).reshape(-1, 3 * k), x.reshape(-1, k)
            seen, place = np.unique(ids.ravel(), return_inverse=True)
            order = np.argsort(place.astype(np.int16 if len(seen) < 1 << 15 else np.int64), kind="stable")
            embed = np.zeros_like(p["embed"])
            embed[seen] = np.add.reduceat((flat @ p["w"].T)[order], np.searchsorted(place[order], np.arange(len(seen))), axis=0)
            grads |= {"u": du, "w": xs.T @ flat, "b": flat.sum(0), "embed": embed}
            h = states[-1]
            self._step(grads, max(1, int(real.sum())))

    def _step(self, grads: dict, n: int) -> None:
        self.t += 1
        scale = self.rate * np.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            g *= np.float32(1 / n)
            m, v = self.m[k], self.v[k]
            m *= np.float32(0.9)
            m += np.float32(0.1) * g
            g *= g
            v *= np.float32(0.99)
            g *= np.float32(0.01)
            v += g
            np.sqrt(v, out=g)
            g += np.float32(1e-7)
            np.divide(m, g, out=g)
            g *= np.float32(scale)
            self.p[k] -= g
