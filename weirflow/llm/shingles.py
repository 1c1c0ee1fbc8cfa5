"""Word shingles of whole texts as 64-bit hashes, by numpy over many texts at once."""

from __future__ import annotations

import numpy as np

K = 5
#: Text bytes handled at once.
BLOCK_BYTES = 1 << 19
_BASE = 0x100000001B3
_INVERSE = pow(_BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingles of each text: A-Z lower-cased, words between ASCII white space.

    A text with fewer than ``K`` words has its whole sequence as one shingle; one
    without words has none.
    """
    out: list[np.ndarray] = []
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) < BLOCK_BYTES):
            size += len(texts[j]) + 1
            j += 1
        out += _sets(texts[i:j])
        i = j
    return out


def _sets(texts: list[bytes]) -> list[np.ndarray]:
    raw = np.frombuffer(b" ".join(texts).lower() + b" ", np.uint8)
    p, inverse = powers(len(raw) + 1)
    inside = ~SPACE[raw]
    edge = np.flatnonzero(np.diff(np.r_[False, inside, False].astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    sums = np.r_[np.uint64(0), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * p[: len(raw)])]
    word = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * STEPS[0])
    stops = np.cumsum([len(t) + 1 for t in texts])
    first = np.searchsorted(starts, np.r_[0, stops])
    n = max(0, len(word) - K + 1)
    runs = np.zeros(n, np.uint64)
    for k in range(K):
        runs = mix(runs + word[k : k + n] * STEPS[k]) if k == K - 1 else runs + mix(word[k : k + n] ^ STEPS[k]) * STEPS[k]
    found = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= K:
            found.append(np.unique(runs[a : b - K + 1]))
        elif b > a:
            h = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for w in word[a:b]:
                    h = mix(np.array([h + w * STEPS[1]], np.uint64))[0]
            found.append(np.array([h], np.uint64))
        else:
            found.append(np.zeros(0, np.uint64))
    return found
