"""Word and shingle hashes of whole texts in numpy, the same on every machine."""

from __future__ import annotations

import numpy as np

from quillmesh.llm.common import BLANK_BYTES

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BLANK = np.zeros(256, dtype=bool)
_BLANK[list(BLANK_BYTES)] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.random.default_rng(20240502).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 1 << 16)
        made = []
        for base in (_BASE, _INVERSE):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        _powers = (made[0], made[1])
    return _powers


def word_hashes(raw: bytes, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word ``[^\\x20\\x09-\\x0D]+`` of UTF-8 bytes; ``lower`` folds A-Z."""
    if lower:
        raw = raw.translate(_LOWER)
    b = np.frombuffer(raw, dtype=np.uint8)
    word = np.empty(len(b) + 2, dtype=bool)
    word[0] = word[-1] = False
    np.logical_not(_BLANK[b], out=word[1:-1])
    turns = np.flatnonzero(word[1:] != word[:-1])
    start, end = turns[::2], turns[1::2]
    if not len(start):
        return start, end, np.empty(0, dtype=np.uint64)
    power, inverse = _power(len(b) + 1)
    sums = np.empty(len(b) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[b] * power[: len(b)], out=sums[1:])
    return start, end, mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = words[:n] * _STEP[0]
    for j in range(1, k):
        out += words[j : j + n] * _STEP[j]
    return mix(out)


def shingle_set(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles of a text, lower-cased in A-Z.

    A text of fewer words is one shingle; one without words has none.
    """
    if not text:
        return np.empty(0, dtype=np.uint64)
    words = word_hashes(text.encode("utf-8", "surrogatepass"), lower=True)[2]
    if not len(words):
        return words
    if len(words) < k:
        return mix(np.array([(words * _STEP[: len(words)]).sum(dtype=np.uint64) + np.uint64(len(words))], dtype=np.uint64))
    return np.unique(grams(words, k))
