"""HyperMinHash sketches: one pass of one hash, 16 bits a bucket.

A shingle's hash chooses a bucket by its top bits; the least of the remaining bits in a
bucket is kept as its leading-zero count (6 bits) and the bits behind the first one
(10 bits). For banding, an empty bucket borrows from the occupied bucket that comes
first in its own fixed random order, which makes every position agree with a
probability equal to the similarity, in small sets as in large ones.
"""

from __future__ import annotations

import numpy as np

from .shingles import STEPS, mix

P, MANTISSA = 8, 10
BUCKETS = 1 << P
EMPTY = 0xFFFF
ROWS = 5
BANDS = BUCKETS // ROWS
_bounds = (np.arange(BUCKETS, dtype=np.uint64) << np.uint64(64 - P)).astype(np.uint64)


def _orders() -> np.ndarray:
    grid = np.arange(BUCKETS * BUCKETS, dtype=np.uint64).reshape(BUCKETS, BUCKETS)
    rank = np.argsort(np.argsort(mix(mix(grid + STEPS[2])), axis=1), axis=1) + 1
    rank[np.arange(BUCKETS), np.arange(BUCKETS)] = 0
    return rank.astype(np.int16)


ORDERS = _orders()


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Registers of a sorted set of 64-bit hashes."""
    at = np.searchsorted(shingles, _bounds)
    some = np.r_[at[1:], len(shingles)] > at
    v = shingles[at[some]] << np.uint64(P)
    # exact in a double after dropping bits that no mantissa reaches
    _, bits = np.frexp((v >> np.uint64(11)).astype(np.float64))
    zeros = np.minimum(53 - bits, 52).astype(np.uint64)
    rest = (v << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    out = np.full(BUCKETS, EMPTY, np.uint16)
    out[some] = (zeros << np.uint64(MANTISSA) | rest).astype(np.uint16)
    return out


def band_keys(registers: np.ndarray) -> np.ndarray:
    """A key for each band of ``ROWS`` positions, empty buckets filled."""
    full = np.flatnonzero(registers != EMPTY)
    source = np.arange(BUCKETS)
    if len(full) < BUCKETS:
        bare = np.flatnonzero(registers == EMPTY)
        source[bare] = full[ORDERS[bare[:, None], full].argmin(axis=1)]
    value = mix(source.astype(np.uint64) << np.uint64(16) | registers[source].astype(np.uint64))
    rows = value[: BANDS * ROWS].reshape(BANDS, ROWS) * STEPS[:ROWS]
    return mix(rows.sum(axis=1, dtype=np.uint64) + mix(np.arange(BANDS, dtype=np.uint64) + STEPS[1]))


def similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard estimates of rows of registers, corrected for registers that agree by chance."""
    some = (a != EMPTY) | (b != EMPTY)
    union = np.maximum(some.sum(axis=1), 1)
    equal = ((a == b) & some).sum(axis=1)
    # expected chance matches a bucket with large sets (Yu and Weber); small sets have fewer
    ratio = np.maximum(n_a, n_b) / np.maximum(np.minimum(n_a, n_b), 1)
    chance = 0.16991948715 * 4 * ratio / (1 + ratio) ** 2 / (1 << MANTISSA)
    return np.clip((equal / union - chance) / (1 - chance), 0, 1)
