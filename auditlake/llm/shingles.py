"""Word shingles of whole texts as 64-bit hashes."""

from __future__ import annotations

import numpy as np

WORDS = 5
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 1 << 16)
        steps = np.full(size, _BASE)
        steps[0] = 1
        back = np.full(size, _U(pow(int(_BASE), -1, 1 << 64)))
        back[0] = 1
        _powers, _inverses = np.multiply.accumulate(steps), np.multiply.accumulate(back)
    return _powers[:n], _inverses[:n]


def shingle_hashes(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles of a text: A to Z in lower case, words are runs of anything but space and U+0009
    to U+000D. A text of fewer words has its whole sequence as one shingle; one without words has none."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    inside = np.concatenate(([False], ~_SPACE[raw], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    powers, inverses = _tables(len(raw))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((_LOWER[raw].astype(np.uint64) + _U(1)) * powers, dtype=np.uint64)))
    words = mix((sums[end] - sums[start]) * inverses[start])
    n = min(WORDS, len(words))
    total = np.full(len(words) - n + 1, _U(n))
    for i in range(n):
        total = mix(total * _BASE + words[i : len(words) - n + 1 + i])
    return np.unique(total)
