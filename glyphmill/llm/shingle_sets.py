"""Hashed word-shingle sets of whole texts, shared by the similarity operators."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words kept with their hashes in each worker.
CACHE = 200_000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ODD = np.uint64(0x9E3779B97F4A7C15)


class WordHash(dict):
    """64-bit hash of a word; bounded, as it starts anew when full."""

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[word] = found
        return found


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scattering of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, width: int, hashes: WordHash) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles of width words; of fewer words, the whole sequence is one.

    A-Z count as lower case and words are runs of bytes other than ASCII white space.
    """
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = len(h) - width + 1
    with np.errstate(over="ignore"):
        if n < 1:
            h, n, width = h, 1, len(h)
        out = np.full(n, np.uint64(width), np.uint64)
        for k in range(width):
            out = mixed(out * _ODD + h[k : k + n])
    return np.unique(out)


def set_key(found: np.ndarray) -> bytes:
    """16 bytes that stand for a set."""
    return xxhash.xxh3_128_digest(found.tobytes())
