"""SimHash near-duplicates found by covering locality-sensitive hashing.

Fingerprint: 64 bits; a bit is set if it is set in more than half of the hashes (XXH64, seed 42) of the
text's word shingles, repeats included.  A-Z are lower-cased first.

Candidates: every bit position gets one of the 2**(radius+1)-1 non-zero vectors over GF(2); the table of a
vector v keeps the bits whose vector has an odd product with v.  At most ``radius`` differing bits leave
some v orthogonal to all of them, so such a pair agrees on all bits of that table: no pair is missed.

Buckets over ``LIMIT`` distinct fingerprints are split by the same construction over the bits that are
still free; a bucket with at most 7 free bits cannot hold more than 128, so this ends and stays exact.
Equal fingerprints are one node throughout, and a bucket gives a spanning forest, never all its pairs.

Defined results: null, empty or blank text has fingerprint zero, and such rows are linked like any
others; texts of fewer words than a shingle hash the whole word sequence; ties and repeated rows are
ordinary copies; a null id never is the least of a component.  An empty table gives no row.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from quire.llm.common import batches, columns_of, utf8, write_shared
from quire.llm.components import components

LIMIT = 1024
_BLOCK = 255 * 256


def fingerprint(text: str | None, width: int = 3) -> int:
    words = utf8(text).lower().split()  # bytes.lower() changes A-Z only
    if not words:
        return 0
    joined = b" ".join(words)
    k = min(width, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = functools.partial(xxhash.xxh64_digest, seed=42)
    n = len(words) - k + 1
    ones = np.zeros(64, np.int64)
    starts, ends = starts[:n].tolist(), ends[k - 1 :].tolist()
    for at in range(0, n, _BLOCK):
        raw = b"".join([digest(joined[a:z]) for a, z in zip(starts[at : at + _BLOCK], ends[at : at + _BLOCK])])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(-1, 64)
        whole = len(bits) // 255 * 255
        if whole:
            ones += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        ones += bits[whole:].sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", width: int = 3, row_col: str | None = None) -> DataFrame:
    """(id, fp) and, with ``row_col``, row: the fingerprint as a signed long."""
    more = [F.col(row_col).alias("row")] if row_col else []
    part = df.select(F.col(id_col).cast("long").alias("id"), *more, F.col(text_col).alias("t"))

    def run(rows):
        for b in batches(rows):
            fps = np.array([fingerprint(t, width) for t in columns_of(b, "t")[0]], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), *b.columns[1:-1]], ["id", "fp", *b.schema.names[1:-1]])

    return part.mapInArrow(run, "id bigint, fp bigint" + (", row bigint" if row_col else ""))


def masks(radius: int, free: int = (1 << 64) - 1) -> list[int]:
    """The tables over the free bits: each mask is the set of bits it compares."""
    vectors = (1 << (radius + 1)) - 1
    out = []
    at = [i for i in range(64) if free >> i & 1]
    for v in range(1, vectors + 1):
        out.append(sum(1 << i for n, i in enumerate(at) if (n % vectors + 1 & v).bit_count() & 1))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges that connect what the links of one bucket connect."""
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    open_, out = np.ones(len(fps), bool), []
    for root in range(len(fps)):
        if not open_[root]:
            continue
        open_[root], todo = False, [root]
        while todo:
            x = todo.pop()
            for y in np.flatnonzero(near[x] & open_).tolist():
                open_[y] = False
                out.append((x, y))
                todo.append(y)
    return out


def _bucket_edges(rows, radius: int):
    """Rows sorted by (mask, key): edges of every bucket.  A bucket has at most LIMIT rows, so what is carried is bounded."""
    rest = [np.zeros(0, np.int64)] * 3

    def edges(m, k, f):
        new = np.flatnonzero((m[1:] != m[:-1]) | (k[1:] != k[:-1])) + 1
        first = np.concatenate([[0], new])
        size = np.diff(np.append(first, len(m)))
        two = first[size == 2]
        a, b = [f[two]], [f[two + 1]]
        ok = np.bitwise_count((a[0] ^ b[0]).view(np.uint64)) <= radius
        a, b = [a[0][ok]], [b[0][ok]]
        for at, n in zip(first[size > 2].tolist(), size[size > 2].tolist()):
            own = f[at : at + n]
            pairs = np.array(_forest(own.view(np.uint64), radius), np.int64).reshape(-1, 2)
            a.append(own[pairs[:, 0]])
            b.append(own[pairs[:, 1]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    for b in batches(rows):
        m, k, f = (np.concatenate([r, b.column(i).to_numpy()]) for i, r in enumerate(rest))
        last = int(np.flatnonzero((m != m[-1]) | (k != k[-1])).max(initial=-1)) + 1
        if last:
            yield edges(m[:last], k[:last], f[:last])
        rest = [m[last:], k[last:], f[last:]]
    if len(rest[0]):
        yield edges(*rest)


def links(fps: DataFrame, radius: int = 3, limit: int = LIMIT) -> DataFrame:
    """(a, b): distinct fingerprints within the radius of each other, enough of the links to connect all that are connected."""
    spark = fps.sparkSession
    rows = fps.select("fp").distinct().select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks(radius)])).alias("mask"))
    found, free = [], {m: (1 << 64) - 1 & ~m for m in masks(radius)}
    while True:
        rows = rows.select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("key"), "fp")
        leaves = [_signed(m) for m, f in free.items() if f.bit_count() <= 7]
        large = rows.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > limit) & ~F.col("mask").isin(leaves))
        large = write_shared(large.select("mask", "key"), "simhash-large")
        last = large.isEmpty()
        small = rows if last else rows.join(large, ["mask", "key"], "left_anti")
        sort = small.repartition("mask", "key").sortWithinPartitions("mask", "key")
        found.append(sort.mapInArrow(lambda it: _bucket_edges(it, radius), "a bigint, b bigint"))
        if last:
            break
        # every large bucket is dealt anew into the tables over its free bits
        finer = {m: masks(radius, f) for m, f in free.items() if f.bit_count() > 7}
        step = [(_signed(m), _signed(m | s)) for m, subs in finer.items() for s in set(subs)]
        free = {m | s: f & ~s for m, f in free.items() if m in finer for s in finer[m]}
        table = spark.createDataFrame(step, "mask bigint, finer bigint")
        rows = rows.join(large, ["mask", "key"], "left_semi").join(F.broadcast(table), "mask").select("fp", F.col("finer").alias("mask")).distinct()
    return functools.reduce(DataFrame.union, found).distinct()


def _labels(fps: DataFrame, radius: int) -> DataFrame:
    """(fp, first, component): each distinct fingerprint, its least id, and the least fingerprint that is reachable."""
    node = fps.groupBy("fp").agg(F.min("id").alias("first"))
    joined = components(links(node.select("fp"), radius))
    return node.join(joined, node.fp == joined.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))


def near_duplicates(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", width: int = 3, radius: int = 3) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (the least id that is reachable)."""
    fps = write_shared(fingerprints(df, text_col, id_col, width), "simhash-fps")
    label = _labels(fps, radius)
    least = label.groupBy("component").agg(F.min("first").alias("component_id"))
    by_fp = label.join(least, "component").select("fp", "component_id")
    out = fps.join(by_fp, "fp")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(df: DataFrame, keep: tuple[str, ...], text_col: str = "text", id_col: str = "doc_id", width: int = 3, radius: int = 3) -> DataFrame:
    """Columns ``keep`` of one row of each group of near-duplicates: that of the least id, null ids last, of equal ids the earlier row."""
    held = {f"k{i}": F.col(c) for i, c in enumerate(keep)}
    text = f"k{keep.index(text_col)}" if text_col in keep else "t"  # a text is held once
    kept = df.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), *[c.alias(k) for k, c in (held | {text: F.col(text_col)}).items()])
    kept = write_shared(kept, "simhash-rows")  # rows have their numbers from here on
    rows = write_shared(fingerprints(kept, text, "id", width, "row"), "simhash-fps")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    by_fp = rows.select("fp", order.alias("o")).groupBy("fp").agg(F.min("o").alias("o"))
    stay = by_fp.join(_labels(rows, radius), "fp").groupBy("component").agg(F.min("o").alias("o")).select(F.col("o.row").alias("row"))
    # one short entry per document that stays is hashed; texts are not sorted
    got = kept.select("row", *[f"k{i}" for i in range(len(keep))]).join(stay.hint("shuffle_hash"), "row", "left_semi")
    return got.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)])
