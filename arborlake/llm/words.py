"""Words of whole texts as 64-bit hashes, for the operators that compare word runs."""

from __future__ import annotations

import numpy as np

#: ASCII bytes that are not letters or digits become blanks, A-Z become a-z.
ALNUM = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)
MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """word -> 64-bit hash, kept for up to ``limit`` words."""

    def __init__(self, limit: int = 100_000):
        import xxhash

        super().__init__()
        self._hash, self._limit = xxhash.xxh3_64_intdigest, limit

    def __missing__(self, word: bytes) -> int:
        value = self._hash(word)
        if len(self) < self._limit and len(word) <= 64:
            self[word] = value
        return value


def alnum_words(text: bytes) -> list[bytes]:
    return text.translate(ALNUM).split()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of ``words[i:i+k]`` for every i at which all k words are there."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = words[:n].copy()
    for j in range(1, k):
        out *= MIX
        out += words[j : j + n]
    return mix(out)
