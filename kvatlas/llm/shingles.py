"""Word shingles as 64-bit hashes, for use inside tasks.

Words are the maximal runs of ``[^\\x20\\x09-\\x0D]`` after lower-casing A-Z; both rules are those
of ``bytes.lower`` and ``bytes.split`` on UTF-8.
"""

from __future__ import annotations

import numpy as np
import xxhash

_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
_MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


class WordHashes(dict):
    """word -> xxhash64, kept between rows; emptied when it holds ``limit`` words."""

    def __init__(self, limit: int = 400_000) -> None:
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, k: int, words: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; fewer words: one shingle of them all; none: empty."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens))
    n = min(k, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = mix(out * _MULTIPLIERS[0] + h[i : len(h) - n + 1 + i])
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def set_digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set, whatever its order."""
    a = int(np.sum(mix(s ^ _MULTIPLIERS[0]), dtype=np.uint64)) if len(s) else 0
    b = int(np.sum(mix(s ^ _MULTIPLIERS[1]), dtype=np.uint64)) if len(s) else 0
    return a - (1 << 63), b - (1 << 63)
