"""SetSketch registers of hashed sets, banding keys and the joint likelihood estimate of similarity.

A register holds ``clip(floor(1 - log_b(h)), 0, q + 1)`` where ``h`` is the least of
the elements' exponential values: a truncated minimum on an exponentially spaced
scale. Registers of a union are the registers' maxima, so sketches merge. Two
sets' registers are equal with a probability close to their Jaccard similarity.
"""

from __future__ import annotations

import numpy as np

BASE, RATE, TOP = 1.001, 20.0, 65534
REGISTERS, BANDS = 160, 32
ROWS = REGISTERS // BANDS
_CHUNK = 256

_rng = np.random.Generator(np.random.PCG64(20240229))
_MUL = _rng.integers(0, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2)
_BAND_MUL = _rng.integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_ADD = _rng.integers(0, 2**63, BANDS, dtype=np.uint64)


def registers(hashes: np.ndarray) -> np.ndarray:
    """The uint16 registers of a non-empty set of 64-bit hashes; memory is bounded for any set size."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), _CHUNK):
        np.minimum(least, (hashes[i : i + _CHUNK, None] * _MUL + _ADD).min(axis=0), out=least)
    u = (least.astype(np.float64) + 0.5) / 2.0**64
    h = -np.log1p(-np.minimum(u, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(h) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One 64-bit key per band (the band's number is mixed in)."""
    x = regs.astype(np.uint64).reshape(BANDS, ROWS)
    key = (x * _BAND_MUL).sum(axis=1, dtype=np.uint64) + _BAND_ADD
    key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (key ^ (key >> np.uint64(32))).view(np.int64)


def estimate(above, below, n_u, n_v) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs, jointly from register order and known cardinalities.

    above, below: how many registers of u are greater, or less, than v's; the
    rest are equal. With BASE near 1 a register of u is greater with probability
    p - qJ where p, q are the shares n_u, n_v of n_u + n_v, less with q - pJ,
    equal otherwise. The log-likelihood is concave in J: ternary search.
    """
    above, below = np.asarray(above, np.float64), np.asarray(below, np.float64)
    p = np.asarray(n_u, np.float64) / (np.asarray(n_u, np.float64) + n_v)
    q, equal, tiny = 1 - p, REGISTERS - above - below, 1e-12

    def likelihood(j):
        up, down = np.maximum(p - q * j, tiny), np.maximum(q - p * j, tiny)
        return above * np.log(up) + below * np.log(down) + equal * np.log(np.maximum(1 - up - down, tiny))

    low, high = np.zeros_like(p), np.minimum(p / q, q / p)
    for _ in range(30):
        third = (high - low) / 3
        a, b = low + third, high - third
        better = likelihood(a) < likelihood(b)
        low, high = np.where(better, a, low), np.where(better, high, b)
    return (low + high) / 2


def margin(threshold: float) -> float:
    """Least estimate still verified: five standard errors below the threshold."""
    return threshold - 5 * np.sqrt(threshold * (1 - threshold) / REGISTERS)
