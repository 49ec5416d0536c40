"""Words and word shingles as arrays of 64-bit hashes."""

from __future__ import annotations

import re

import numpy as np
import xxhash

from .common import Memo, mix64

WORD = re.compile(r"\w+")

#: Words of a shingle, and the similarity from which documents are near duplicates.
SHINGLE, SIMILAR = 5, 0.8


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class Shingler:
    """Turns a text into its sorted distinct shingle hashes."""

    def __init__(self, n: int = SHINGLE):
        self.n, self.hashes = n, Memo(xxhash.xxh3_64_intdigest)
        with np.errstate(over="ignore"):
            self.factors = mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

    def word_hashes(self, text: str | None) -> np.ndarray:
        found = words(text)
        return np.fromiter(map(self.hashes.__getitem__, found), dtype=np.uint64, count=len(found))

    def shingles(self, text: str | None) -> np.ndarray:
        """A text of fewer than n words has one shingle, the words it has; a text without words has none."""
        w = self.word_hashes(text)
        if not len(w):
            return w
        n = min(self.n, len(w))
        last = len(w) - n + 1
        with np.errstate(over="ignore"):
            total = np.full(last, n, dtype=np.uint64)
            for i in range(n):
                total += w[i : i + last] * self.factors[i]
        return np.unique(mix64(total))
