"""Hashes of words and of runs of words, as numpy arrays."""

from __future__ import annotations

import numpy as np
import xxhash

from quire.llm.chunks import Cache
from quire.llm.common import mix64, utf8

#: Odd multipliers of two independent polynomial hashes modulo 2**64.
BASES = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


class WordHash:
    """Text -> one 64-bit hash per word [^\\x20\\x09-\\x0D]+, the frequent ones cached."""

    def __init__(self):
        self.known = Cache(xxhash.xxh64_intdigest, 100_000)

    def __call__(self, text: str | None) -> np.ndarray:
        words = utf8(text).split()
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))


def runs(h: np.ndarray, k: int, base: np.uint64 = BASES[0]) -> np.ndarray:
    """A mixed hash of each k consecutive words (none if there are fewer)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if k <= 12:
        x = h[:n].copy()
        for j in range(1, k):
            x *= base
            x += h[j : j + n]
        return mix64(x)
    # halve: the run is its first half, shifted, plus its second half
    return mix64(_span(h, k, base))


def _span(h: np.ndarray, k: int, base: np.uint64) -> np.ndarray:
    n = len(h) - k + 1
    if k == 1:
        return h[:n].copy()
    half = k // 2
    part = _span(h, half, base)
    out = part[:n] * np.uint64(pow(int(base), k - half, 1 << 64))
    out += _tail(part, h, half, k - half, base)[half : half + n]
    return out


def _tail(part: np.ndarray, h: np.ndarray, half: int, rest: int, base: np.uint64) -> np.ndarray:
    """Spans of `rest` words, which is half or half + 1."""
    if rest == half:
        return part
    return part[: len(part) - 1] * base + h[half : half + len(part) - 1]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values."""
    have, m = 1, x
    while have * 2 <= w:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    return np.minimum(m[: len(m) - (w - have)], m[w - have :]) if have < w else m
