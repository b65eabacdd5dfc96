"""Hashes of word windows and of bytes, over whole Arrow batches with numpy.

Words are the runs ``[^\\x20\\x09-\\x0D]+`` of a text in UTF-8.  A word has a 64-bit
hash, and a window's hashes (64 and 32 bits) are polynomials of its words'
hashes, mixed.  Two different windows meet in all 96 bits with a chance of about
n^2 / 2^97 for n windows: 10^-3 for the 10^13 windows of a 100 TB corpus.
"""

from __future__ import annotations

import numpy as np
import xxhash

_M1 = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xD6E8FEB86659FD93)
_X1 = np.uint64(0xBF58476D1CE4E5B9)
_X2 = np.uint64(0x94D049BB133111EB)
#: Words whose hash a worker remembers.
REMEMBERED = 600_000


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h *= _X1
    h ^= h >> np.uint64(27)
    h *= _X2
    h ^= h >> np.uint64(31)
    return h


class WordHasher(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        self[word] = h
        return h

    def hashes(self, words: list[bytes]) -> np.ndarray:
        if len(self) > REMEMBERED:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def words_of(texts: list[bytes], hasher: WordHasher) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, one after the other, and each text's number of words."""
    split = [t.split() for t in texts]
    parts = [hasher.hashes(w) for w in split]
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.array([len(w) for w in split], np.int64)


def window_hashes(words: np.ndarray, counts: np.ndarray, k: int, wide: bool = True) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """For windows of k words inside one text: 64-bit hash, 32-bit hash (if wide), number of the text."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32) if wide else None, np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(counts)), counts)
    inside = text[:n] == text[k - 1 :]
    a = words[:n].copy()
    for j in range(1, k):
        a *= _M1
        a += words[j : j + n]
    h1 = mix(a[inside])
    h2 = None
    if wide:
        other = mix(words ^ _M2)
        b = other[:n].copy()
        for j in range(1, k):
            b *= _M2
            b += other[j : j + n]
        h2 = (mix(b[inside]) >> np.uint64(32)).astype(np.uint32)
    return h1, h2, text[:n][inside]
