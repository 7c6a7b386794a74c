"""Word shingles as sorted 64-bit hashes, computed in batches."""

from __future__ import annotations

import numpy as np
import xxhash

_MULTIPLY = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], dtype=np.uint64)
_CACHE = 50_000


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_HASH = _WordHash()


def words(text: str | None) -> list[bytes]:
    """Runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_hashes(parts: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASH.__getitem__, parts), np.uint64, len(parts))


def ngram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of every window of k words; none if there are fewer."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = hashes[:n] * _MULTIPLY[0]
    for i in range(1, k):
        h += hashes[i : n + i] * _MULTIPLY[i % 8]
        h ^= h >> np.uint64(29)
        h *= _MULTIPLY[(i + 3) % 8]
    h ^= h >> np.uint64(32)
    return h


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes; a text of fewer than k words, but at least
    one, has its whole sequence as its only shingle."""
    parts = words(text)
    if not parts:
        return np.empty(0, np.uint64)
    return np.unique(ngram_hashes(word_hashes(parts), min(k, len(parts))))


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))
