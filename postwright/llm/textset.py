"""Words and shingle sets of texts, as hashed numpy arrays (used inside Arrow UDFs)."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

#: Distinct words whose hash a Python worker remembers before it starts afresh.
WORD_CACHE = 400_000
_MIX_A, _MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_MIX_C = np.uint64(0x94D049BB133111EB)


class WordHashes(dict):
    """word -> 64-bit hash, computed on first sight; bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def words(text: str | None) -> list[bytes]:
    """Words of a text, A-Z in lower case. Bytes of UTF-8: both rules are ASCII rules."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_B
    x = (x ^ (x >> np.uint64(27))) * _MIX_C
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int, cache: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles; fewer words make one shingle, none an empty set."""
    found = words(text)
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, found), np.uint64, len(found))
    n = max(1, len(found) - size + 1)
    width = min(size, len(found))
    out = np.full(n, np.uint64(width))
    for i in range(width):
        out = mix(out * _MIX_A + h[i : i + n])
    return np.unique(out)


def set_digest(hashes: np.ndarray) -> bytes | None:
    """Identity of a shingle set: 128 bits; None for an empty set."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None
