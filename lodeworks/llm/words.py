"""Words as 64-bit hashes in numpy, for operators that work on all words of all texts."""

from __future__ import annotations

import numpy as np
import xxhash


class WordHashes(dict):
    """Word (bytes) -> 64-bit hash; emptied when it has grown to ``bound`` words."""

    def __init__(self, bound: int = 400_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def raw(text: str | None, lower: bool = False) -> list[bytes]:
    """Words between ASCII white space, as UTF-8; A-Z lower-cased if asked for."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return (data.lower() if lower else data).split()


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A permutation of 64-bit values."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
