"""Words, shingles and their 64-bit digests, for tasks in Python."""

from __future__ import annotations

import numpy as np
import xxhash

STEP = np.uint64(0x9E3779B97F4A7C15)


class WordDigests(dict):
    """Word (bytes) -> digest; forgets all when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """Runs of anything but ASCII blanks, in UTF-8; lower-cases A-Z only.  (Bytes split at exactly these six blanks.)"""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def mixed(values: np.ndarray) -> np.ndarray:
    """Spreads every bit of the values over all bits."""
    v = values ^ (values >> np.uint64(31))
    v = v * np.uint64(0xBF58476D1CE4E5B9)
    v ^= v >> np.uint64(29)
    v = v * np.uint64(0x94D049BB133111EB)
    return v ^ (v >> np.uint64(32))


def grams(digests: np.ndarray, size: int) -> np.ndarray:
    """Digests of all runs of ``size`` words, in order; none if there are fewer words."""
    n = len(digests) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, size, np.uint64)
    for k in range(size):
        total = total * STEP + digests[k:k + n]
    return mixed(total)


def shingle_set(digests: np.ndarray, size: int) -> np.ndarray:
    """Distinct shingles, ascending; a shorter text is one shingle, an empty one has none."""
    if not len(digests):
        return np.zeros(0, np.uint64)
    return np.unique(grams(digests, min(size, len(digests))))
