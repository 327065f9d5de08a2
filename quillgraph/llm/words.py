"""Words of whole texts for operators that score them in Python: UTF-8 bytes, ASCII white space, cached hashes."""

from __future__ import annotations

import numpy as np
import xxhash

U64 = np.uint64
MIX_A, MIX_B = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)


class WordHashes(dict):
    """Word (bytes) to a 64-bit hash of its normal form, computed once per word; forgets all when full."""

    def __init__(self, normal=None, most: int = 100_000):
        super().__init__()
        self.normal, self.most = normal, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(self.normal(word) if self.normal else word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=U64, count=len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = (h ^ (h >> U64(31))) * MIX_A
    h = (h ^ (h >> U64(29))) * MIX_B
    return h ^ (h >> U64(32))


def joined(*hashes: np.ndarray) -> np.ndarray:
    """One hash for each tuple of hashes, order included."""
    out = hashes[0]
    for h in hashes[1:]:
        out = mixed(out) + h
    return mixed(out)
