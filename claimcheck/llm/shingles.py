"""Words of a text as 64-bit hashes, and hashes of runs of words."""

from __future__ import annotations

import numpy as np
import xxhash

FACTOR = np.uint64(0x9E3779B97F4A7C15)


class WordHashes:
    """Hashes of words (bytes between ASCII white space); hashing one again is cheaper than looking it up."""

    def of(self, text: str | None, lower: bool = False) -> np.ndarray:
        raw = (text or "").encode()
        words = (raw.lower() if lower else raw).split()
        return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def runs(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k words, in order."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            total = total * FACTOR + words[i : i + n]
    return mixed(total)


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """The distinct runs of k words, ascending; a text of fewer words has one shingle, all its words."""
    return np.unique(runs(words, min(k, len(words)))) if len(words) else np.zeros(0, dtype=np.uint64)
