"""Character-gram hashing of whole Arrow batches in numpy."""

from __future__ import annotations

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15)
_A = np.uint64(0xBF58476D1CE4E5B9)
_B = np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser: spreads a hash over all 64 bits."""
    h = (h ^ (h >> np.uint64(30))) * _A
    h = (h ^ (h >> np.uint64(27))) * _B
    return h ^ (h >> np.uint64(31))


def codes(text: str) -> np.ndarray:
    """Code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def rolling(c: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all windows of q code points."""
    if len(c) < q:
        return np.zeros(0, dtype=np.uint64)
    c = c.astype(np.uint64)
    n = len(c) - q + 1
    h = np.zeros(n, dtype=np.uint64)
    for k in range(q):
        h *= _P
        h += c[k : k + n]
    return mix(h)


def chunks_of(texts, limit: int = 1 << 20):
    """Slices (from, to) of a list of texts with about `limit` characters."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) if t is not None else 0
        if size >= limit:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)
