"""Byte-pair merges of many words at once, in numpy.

Words of equal length are the rows of a matrix of ids.  In each round every row takes its merge of least
rank, at the leftmost place, and so loses one column; rows without a merge leave.  Only the two pairs beside
a merge are looked up again.
"""

from __future__ import annotations

import numpy as np

NONE = 0xFFFF
_BITS = 19


class Merges:
    """Merges of ids (first, second, merged) in order of rank; ids and ranks below 2**16 - 1."""

    def __init__(self, merges: list[tuple[int, int, int]]):
        self.made = np.array([m for _, _, m in merges], np.uint16)
        self.keys = np.full(1 << _BITS, 0xFFFFFFFF, np.uint32)
        self.ranks = np.full(1 << _BITS, NONE, np.uint16)
        for rank, (a, b, _) in enumerate(merges):
            at = ((a << 16 | b) * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - _BITS)
            while self.keys[at] != 0xFFFFFFFF:
                at = (at + 1) & ((1 << _BITS) - 1)
            self.keys[at], self.ranks[at] = a << 16 | b, rank

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.uint32) << np.uint32(16) | b
        at = key * np.uint32(0x9E3779B1) >> np.uint32(32 - _BITS)
        out = self.ranks[at]
        todo = np.flatnonzero(self.keys[at] != key)
        key, at = key.ravel()[todo], at.ravel()[todo]
        flat = out.reshape(-1)
        while len(todo):
            flat[todo] = NONE
            more = self.keys[at] != 0xFFFFFFFF
            todo, key, at = todo[more], key[more], (at[more] + np.uint32(1)) & np.uint32((1 << _BITS) - 1)
            same = self.keys[at] == key
            flat[todo[same]] = self.ranks[at[same]]
            todo, key, at = todo[~same], key[~same], at[~same]
        return out

    def rows(self, s: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(row numbers, their merged ids) by final length; s is a matrix of ids, one word a row."""
        out, row = [], np.arange(len(s))
        s = s.astype(np.uint16)
        rank = self._rank(s[:, :-1], s[:, 1:])
        while s.shape[1] > 1 and len(s):
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(s)), at]
            live = best != NONE
            if not live.all():
                out.append((row[~live], s[~live]))
                s, rank, row, at, best = s[live], rank[live], row[live], at[live], best[live]
            m, n = s.shape
            r = np.arange(m)
            s[r, at] = self.made[best]
            stay = np.ones((m, n), bool)
            stay[r, at + 1] = False
            s = s[stay].reshape(m, n - 1)
            stay = np.ones((m, n - 1), bool)
            stay[r, at] = False
            rank = rank[stay].reshape(m, n - 2)
            i = np.flatnonzero(at > 0)
            rank[i, at[i] - 1] = self._rank(s[i, at[i] - 1], s[i, at[i]])
            i = np.flatnonzero(at < n - 2)
            rank[i, at[i]] = self._rank(s[i, at[i]], s[i, at[i] + 1])
        out.append((row, s))
        return out
