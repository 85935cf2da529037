"""Word shingles as 64-bit fingerprints, vectorised with numpy."""

from __future__ import annotations

import numpy as np
import xxhash

_U = np.uint64


def splitmix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed 64-bit numbers of a seed."""
    return splitmix(_U(seed) + (np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)))


class WordHashes(dict):
    """64-bit hashes of words, remembered; forgets all when it has too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def split(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased words; bytes.split() and bytes.lower() know ASCII alone, which is the definition."""
    return text.lower().split() if text else []


class Shingler:
    def __init__(self, k: int = 5):
        self.k, self.hashes, self.factors = k, WordHashes(), stream(k, k) | _U(1)

    def __call__(self, text: bytes | None) -> np.ndarray:
        """The sorted distinct k-word shingles of a text; fewer words are one shingle; none, none."""
        found = split(text)
        if not found:
            return np.empty(0, _U)
        if len(found) < self.k:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), seed=len(found))], _U)
        w = np.fromiter(map(self.hashes.__getitem__, found), _U, len(found))
        n = len(w) - self.k + 1
        total = w[:n] * self.factors[0]
        for j in range(1, self.k):
            total += w[j : j + n] * self.factors[j]
        return np.unique(splitmix(total))
