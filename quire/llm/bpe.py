"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one resolves whole pre-tokens that are in the vocabulary through a minimal perfect hash (hash and
displace: one displacement per bucket, one slot per token, the slot's bytes are compared).  Tier two
merges the rest with a heap over linked bytes.  Ranks come from a file whose path is a parameter; the
driver reads it and broadcasts the table, whose size is that of the vocabulary.

Defined results: null text is empty, and an empty text has no ids; a lone surrogate keeps its three
bytes; texts of any length are encoded whole; repeated rows each get a row; other input columns are
left out, so their names cannot clash.
"""

from __future__ import annotations

import base64
import functools
import heapq
import struct

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from quire.llm.chunks import PATTERN, Cache, Chunked, simple
from quire.llm.common import batches, columns_of, utf8

MASK = (1 << 64) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PerfectHash:
    """Minimal perfect hash over the tokens: get(bytes) -> id, or -1."""

    def __init__(self, ranks: dict[bytes, int]):
        n = len(ranks)
        self.n, self.buckets = n, max(1, n // 3)
        self.keys: list[bytes] = [b""] * n
        self.ids = [0] * n
        self.shift = [0] * self.buckets
        groups: list[list[bytes]] = [[] for _ in range(self.buckets)]
        for key in ranks:
            groups[xxhash.xxh64_intdigest(key) % self.buckets].append(key)
        free = [True] * n
        order = sorted(range(self.buckets), key=lambda b: -len(groups[b]))
        for b in order:
            mine = [xxhash.xxh64_intdigest(k) for k in groups[b]]
            if len(mine) < 2:
                break
            d = 1
            while True:
                slots = [self._slot(h, d) for h in mine]
                if len(set(slots)) == len(slots) and all(free[s] for s in slots):
                    break
                d += 1
            self.shift[b] = d
            for k, s in zip(groups[b], slots):
                free[s], self.keys[s], self.ids[s] = False, k, ranks[k]
        left = iter([s for s in range(n) if free[s]])
        for b in order:
            if len(groups[b]) == 1:  # a bucket of one token names its slot
                s, k = next(left), groups[b][0]
                self.shift[b], self.keys[s], self.ids[s] = -1 - s, k, ranks[k]

    def _slot(self, h: int, d: int) -> int:
        x = (h ^ (d * 0x9E3779B97F4A7C15)) & MASK
        x = ((x ^ (x >> 31)) * 0xBF58476D1CE4E5B9) & MASK
        return (x >> 16) % self.n

    def get(self, key: bytes) -> int:
        h = xxhash.xxh64_intdigest(key)
        d = self.shift[h % self.buckets]
        s = -1 - d if d < 0 else self._slot(h, d)
        return self.ids[s] if self.keys[s] == key else -1


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the pair of lowest rank, leftmost first, is merged until none is left."""
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    after, before, cur = list(range(1, n + 2)), list(range(-1, n)), [-1] * (n + 1)
    get, heap = ranks.get, []
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            cur[i] = r
            heap.append(r << 32 | i)
    heapq.heapify(heap)
    while heap:
        x = heapq.heappop(heap)
        i = x & 0xFFFFFFFF
        if cur[i] != x >> 32:
            continue  # one of its halves has changed since
        j = after[i]
        k = after[j]
        after[i], cur[j] = k, -1
        if k <= n:
            before[k] = i
        for a, z in ((i, after[k] if k < n else 0), (before[i], k)):
            if a >= 0:
                r = get(piece[a:z]) if z else None
                if r is None:
                    cur[a] = -1
                else:
                    cur[a] = r
                    heapq.heappush(heap, r << 32 | a)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        # White_Space of Unicode, spelled out: the regex module's own \s also takes U+001C to U+001F
        space = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
        spelled = pattern.replace(r"[^\s", "[^" + space).replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]")
        self.pieces, self.cuts = regex.compile(spelled, regex.V0).findall, pattern == PATTERN
        self.ranks, self.whole = ranks, PerfectHash(ranks)
        self.vocab: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for k, r in ranks.items():
            self.vocab[r] = k

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("pieces", "chunked", "known")} | {"pattern": self.pieces.__self__.pattern}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.pieces = regex.compile(self.__dict__.pop("pattern"), regex.V0).findall

    @functools.cached_property
    def known(self) -> Cache:
        return Cache(self._piece, 300_000)

    @functools.cached_property
    def chunked(self) -> Chunked:
        known = self.known

        def make(chunk: str) -> bytes:
            got = simple(chunk) or self.pieces(chunk)
            return known[got[0]] if len(got) == 1 else b"".join([known[p] for p in got])

        def spaced(chunk: str) -> bytes:
            got = simple(chunk)
            if got is None:
                return make(" " + chunk)
            one = known[" " + got[0]]
            return one if len(got) == 1 else one + known[got[1]]

        return Chunked(make, spaced)

    def _piece(self, piece: str) -> bytes:
        raw = utf8(piece)
        one = self.whole.get(raw)
        ids = merge(raw, self.ranks) if one < 0 else (one,)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not self.cuts:
            return b"".join([self.known[p] for p in self.pieces(text or "")])
        return b"".join(self.chunked(text or ""))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocab.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _each(df: DataFrame, encoder: Encoder, keep: list[str], col: Column, out: str, do: str) -> DataFrame:
    sent = df.sparkSession.sparkContext.broadcast(encoder)
    part = df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keep)], col.alias("_v"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in part.schema.fields[:-1])

    def run(rows):
        f = getattr(sent.value, do)
        for whole in batches(rows):
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(map(f, columns_of(b, "_v")[0]), pa.binary())], [*b.schema.names[:-1], "_o"])

    done = part.mapInArrow(run, f"{fields}, _o binary")
    return done.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keep)], F.col("_o").alias(out))


def encode(df: DataFrame, encoder: Encoder, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and ``ids`` (binary, little-endian unsigned 32-bit integers)."""
    return _each(df, encoder, list(keep), F.col(text_col), "ids", "encode")


def decode(df: DataFrame, encoder: Encoder, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and ``decoded`` (binary); null ids decode to nothing."""
    return _each(df, encoder, list(keep), F.coalesce(F.col(ids_col), F.lit(b"")), "decoded", "decode")
