"""Word shingles as 64-bit numbers, computed per Arrow batch inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

CACHE_WORDS = 500_000        # words whose hash a task remembers; it starts anew beyond


def mixed(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Word -> 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHE_WORDS:
            self[word] = value
        return value

    def of(self, text: str | None) -> np.ndarray:
        """Hashes of the words ``[^\\x20\\x09-\\x0D]+``, A-Z in lower case."""
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


STEP = 0x9E3779B97F4A7C15    # odd, so it has an inverse modulo 2^64
BACK = pow(STEP, -1, 2 ** 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``STEP`` and of its inverse, kept for the longest text so far."""
    while len(_powers[0]) < count:
        for k, base in enumerate((STEP, BACK)):
            known = _powers[k]
            ahead = np.uint64(pow(base, len(known), 2 ** 64))
            _powers[k] = np.concatenate([known, known * ahead])
    return _powers[0][:count], _powers[1][:count]


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` consecutive words, in order, by differences of one running sum."""
    count = len(words) - size + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    up, down = powers(len(words))
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up, out=total[1:])
    return mixed((total[size:] - total[:count]) * down[:count])


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingles; the whole sequence as one if it is shorter."""
    if not len(words):
        return np.empty(0, np.uint64)
    if len(words) < size:
        return windows(words, len(words)) ^ np.uint64(len(words))
    return np.unique(windows(words, size))
