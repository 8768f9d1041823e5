"""Words as 64-bit hashes, cached per Python worker.

The cache is emptied when it is full, which changes speed and never a result.
"""

from __future__ import annotations

import numpy as np
import xxhash

from shelfmark.llm.store import CACHES

CACHE_WORDS = 100_000
_MIX_A, _MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class WordHashes(dict):
    """bytes -> unsigned 64-bit hash, filled on demand."""

    def __missing__(self, word):
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_hashes = WordHashes()
CACHES["ngram_join"] = _hashes.clear


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs outside ASCII white space (space and 09-0D), A-Z lower-cased; UTF-8 bytes."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def hashed(words: list[bytes]) -> np.ndarray:
    """One unsigned 64-bit hash a word."""
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """Hashes of every run of ``width`` words in order; shorter texts give their whole sequence as one; no word, none.

    Two different shingles share a 64-bit hash with a chance of about 5e-20 a pair.
    """
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    if n < width:
        return mixed(np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=width + n)], np.uint64))
    h = hashed(words)
    out = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : n - width + 1 + k]
    return mixed(out)
