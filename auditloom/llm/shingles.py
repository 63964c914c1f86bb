"""Word shingles of texts as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

_M = np.uint64(0x9E3779B97F4A7C15)
_S = np.uint64(0xD6E8FEB86659FD93)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(32))) * _S
    h = (h ^ (h >> np.uint64(29))) * _M
    return h ^ (h >> np.uint64(32))


class Shingler(dict):
    """Distinct shingle hashes of texts; keeps the hashes of up to `most` words.

    A-Z is lower-cased and words are what ASCII white space parts. A text of fewer words than a shingle has the whole
    sequence as its one shingle; one without words has none. Two different shingles have one hash with a chance of
    2**-64, so that counts over hashes are those over shingles.
    """

    def __init__(self, words: int, most: int = 150_000):
        self.words, self.most = words, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def all_hashes(self, text: str | None) -> np.ndarray:
        """The hash of each shingle in text order."""
        words = (text or "").encode().lower().split()
        if not words:
            return np.empty(0, np.uint64)
        w = np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))
        k = min(self.words, len(w))
        h = np.full(len(w) - k + 1, k, dtype=np.uint64)
        for j in range(k):
            h = mixed(h * _M + w[j : len(w) - k + 1 + j])
        return h

    def hashes(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes."""
        h = np.sort(self.all_hashes(text))
        return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h
