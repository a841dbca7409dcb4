"""Sets of word shingles: their hashes, the buckets of texts that are alike, and exact Jaccard similarity.

Two sets of Jaccard similarity s agree in the least hash of a random order with probability s. `BANDS` buckets are made
of the least hashes of `ROWS` orders each; at least a pair of similarity 0.8 shares one of 20 buckets of 4 with a
probability of 1 - 3e-5 (0.85: 1 - 4e-7). Equal sets are told by a 64-bit hash of the whole set.

Words are those between ASCII white space, A-Z in lower case. A text of fewer words than `width` has itself as its one
shingle; a text without words has an empty set.
"""

from __future__ import annotations

import numpy as np
import xxhash

from quarry.llm.shared import LOWER

BANDS, ROWS = 20, 4
_MIX = np.random.default_rng(42).integers(0, 1 << 64, (2, BANDS * ROWS, 1), dtype=np.uint64) | np.array([[[0]], [[1]]], np.uint64)
#: Shingles whose minima are taken at once.
_AT_ONCE = 1 << 11


def shingles(text: bytes, width: int = 5, seed: int = 42) -> np.ndarray:
    """The 64-bit hashes of a UTF-8 text's shingles, in order, with repeats."""
    found = text.translate(LOWER).split()
    if not found:
        return np.zeros(0, np.uint64)
    whole, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= width:
        return np.array([digest(whole, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    begin = np.concatenate([[0], ends[:-width]]).tolist()
    return np.array([digest(whole[a:b], seed) for a, b in zip(begin, (ends[width - 1 :] - 1).tolist(), strict=True)], np.uint64)


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets, as sorted arrays, have a Jaccard similarity of at least `similarity`."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both)


def node(own: np.ndarray) -> int:
    """The 64-bit name of a set of shingles, as a signed long."""
    h = xxhash.xxh64_intdigest(own.tobytes()) if len(own) else 0
    return h - (1 << 64) if h >> 63 else h


def bands(own: np.ndarray) -> np.ndarray:
    """One signed long per band of a set that isn't empty."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for i in range(0, len(own), _AT_ONCE):
        least = np.minimum(least, ((own[i : i + _AT_ONCE] ^ _MIX[0]) * _MIX[1]).min(axis=1))
    return np.array([xxhash.xxh64_intdigest(m.tobytes(), t) for t, m in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)
