"""Document fingerprints from statistically improbable features.

Every window of 64 bytes has a Shannon entropy; how far that lies from what running text usually has is its
rarity (a fixed rule, so that a fingerprint depends on its own text alone).  Sliding over the text, the
rarest window of each 64 neighbouring ones is voted for; windows with at least ``VOTES`` votes in a row are
features.  A feature sets five bits (SHA-1) in a Bloom filter of 2048 bits; after ``PER_FILTER`` features the
next filter of the chain begins.  Likeness is the overlap of bits, normalised by what chance gives and by
the fewer bits of the two, the best partner for each filter of the shorter chain, averaged by features.

Neighbours in id order meet without a global sort: ids are cut into ranges at approximate quantiles, each
range also gets the first row of the range after it, and every partition streams its sorted rows.

Defined results: null text is empty; an empty text has a chain without filters and is like another empty
text only; a text under 64 bytes is one feature; rows with null ids come first, rows that repeat an id are
ordered by text; a table of one row is its own next; columns other than id and text are left out.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quire.llm.common import batches, columns_of, utf8

WINDOW, VOTES, PER_FILTER, BITS = 64, 16, 160, 2048
_BLOCK = 1 << 20
_ONE = 1 << 16
_F = np.array([0] + [round(n * np.log2(n) * _ONE) for n in range(1, 66)], np.int64)
_G = np.diff(_F)
_FULL = 6 * WINDOW * _ONE
#: Entropy (thousandths of its greatest value) where running text lies, and below which a window is noise.
USUAL, NOISE = 700, 100


def _levels_block(b: np.ndarray) -> np.ndarray:
    n = len(b) - WINDOW + 1
    at = np.argsort(b, kind="stable").astype(np.int32)
    key = (b[at].astype(np.int32) << 22) + at
    back, ahead = np.zeros(len(b), np.uint8), np.zeros(len(b), np.uint8)
    for lag in range(1, WINDOW):
        near = key[lag:] - key[:-lag] < WINDOW  # the same byte, at most 63 places away
        if not near.any():
            break
        back[lag:] += near
        ahead[:-lag] += near
    a, z = np.empty_like(back), np.empty_like(ahead)
    a[at], z[at] = back, ahead
    s = np.empty(n, np.int64)
    s[0] = _F[np.bincount(b[:WINDOW], minlength=256)].sum()
    if n > 1:
        s[1:] = _G[a[WINDOW:]] - _G[z[: n - 1]]
        np.cumsum(s, out=s)
    e = (_FULL - s) * 1000 // _FULL
    rank = (1000 - np.abs(e - USUAL)).astype(np.uint16)
    rank[e < NOISE] = 2000
    return rank


def ranks(b: np.ndarray) -> np.ndarray:
    """Rank of every window of 64 bytes; the smaller the rarer."""
    n = len(b) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.uint16)
    return np.concatenate([_levels_block(b[at : min(at + _BLOCK, n) + WINDOW - 1]) for at in range(0, n, _BLOCK)])


def select(rank: np.ndarray) -> np.ndarray:
    """Starts of the features."""
    n = len(rank)
    if n <= WINDOW:
        return np.array([int(rank.argmin())]) if n else np.zeros(0, np.int64)
    won = []
    for at in range(0, n - WINDOW + 1, _BLOCK):
        r = rank[at : at + _BLOCK + WINDOW - 1].astype(np.uint64)
        x = r << np.uint64(32) | np.arange(len(r), dtype=np.uint64)
        for have in (1, 2, 4, 8, 16, 32):
            x = np.minimum(x[:-have], x[have:])
        won.append((x & np.uint64(0xFFFFFFFF)).astype(np.int64) + at)
    won = np.concatenate(won)  # never decreases: the leftmost of equal ranks wins
    first = np.flatnonzero(np.diff(won, prepend=-1))
    votes = np.diff(np.append(first, len(won)))
    ok = votes >= VOTES
    return won[first[ok]] if ok.any() else won[first[[votes.argmax()]]]


class Chain:
    """Bloom filters (rows of 2048 bits) and the number of features in each."""

    def __init__(self, filters: np.ndarray, counts: np.ndarray):
        self.words = filters.view(np.uint64)
        self.filters, self.counts = filters, counts
        self.ones = np.bitwise_count(self.words).sum(axis=1).astype(np.float64) if len(filters) else np.zeros(0)

    def text(self) -> str:
        last = int(self.counts[-1]) if len(self.counts) else 0
        return f"{len(self.counts)}:{last}:{base64.b64encode(self.filters.tobytes()).decode()}"

    @classmethod
    def parse(cls, text: str) -> "Chain":
        n, last, raw = text.split(":")
        filters = np.frombuffer(base64.b64decode(raw), np.uint8).reshape(int(n), BITS // 8)
        counts = np.full(int(n), PER_FILTER)
        counts[-1:] = int(last)
        return cls(filters, counts)

    def likeness(self, other: "Chain") -> float:
        a, b = (self, other) if len(self.counts) <= len(other.counts) else (other, self)
        if not len(a.counts):
            return float(not len(b.counts))
        total = 0.0
        for words, ones, n in zip(a.words, a.ones, a.counts):
            common = np.bitwise_count(words & b.words).sum(axis=1)
            chance, most = ones * b.ones / BITS, np.minimum(ones, b.ones)
            cut = chance + 0.3 * (most - chance)
            total += n * max(0.0, float(((common - cut) / np.maximum(most - cut, 1e-9)).max()))
        return min(1.0, total / float(a.counts.sum()))


def chain(raw: bytes, rank: np.ndarray) -> Chain:
    if len(raw) < WINDOW:
        parts = [raw] if raw else []
    else:
        parts = [raw[p : p + WINDOW] for p in select(rank).tolist()]
    n = -(-len(parts) // PER_FILTER)
    on = np.zeros((n, BITS), bool)
    if n:
        bit = np.frombuffer(b"".join([hashlib.sha1(p).digest() for p in parts]), ">u4").reshape(-1, 5) % BITS
        on[(np.arange(len(parts)) // PER_FILTER)[:, None], bit] = True
    counts = np.full(n, PER_FILTER)
    if n:
        counts[-1] = len(parts) - (n - 1) * PER_FILTER
    return Chain(np.packbits(on, axis=1) if n else np.zeros((0, BITS // 8), np.uint8), counts)


class Document:
    def __init__(self, text: str | None):
        self.text = text or ""
        self.raw = utf8(self.text)
        self.rank = ranks(np.frombuffer(self.raw, np.uint8))
        self.chain = chain(self.raw, self.rank)


def edited(doc: Document, nxt: Document) -> tuple[bytes, Chain]:
    """The text whose second half is the beginning of the next one; ranks away from the seam are reused."""
    half = len(doc.text) // 2
    head, tail = utf8(doc.text[: len(doc.text) - half]), utf8(nxt.text[:half])
    raw, seam = head + tail, WINDOW - 1
    if len(head) < seam or len(tail) < seam:
        return raw, chain(raw, ranks(np.frombuffer(raw, np.uint8)))
    cross = ranks(np.frombuffer(raw[len(head) - seam : len(head) + seam], np.uint8))
    return raw, chain(raw, np.concatenate([doc.rank[: len(head) - seam], cross, nxt.rank[: len(tail) - seam]]))


def _ranges(df: DataFrame, per_range: int, most: int) -> tuple[DataFrame, list]:
    """df (id, t) with column range, and (least id, range) of every range that has rows, in order."""
    from pyspark.ml.feature import Bucketizer

    ids = df.select(F.col("id").cast("double").alias("x")).where("x is not null")
    n = min(most, -(-ids.count() // per_range))
    cuts = sorted(set(ids.approxQuantile("x", [i / n for i in range(1, n)], 0.2 / n))) if n > 1 else []
    splits = [float("-inf"), *cuts, float("inf")]
    held = df.withColumn("x", F.coalesce(F.col("id").cast("double"), F.lit(float("-inf"))))
    held = Bucketizer(splits=splits, inputCol="x", outputCol="range").transform(held).withColumn("range", F.col("range").cast("int")) if cuts else held.withColumn("range", F.lit(0))
    first = held.select("range", "id").groupBy("range").agg(F.min(F.struct(F.col("id").isNotNull().alias("known"), F.col("id").alias("id"))).alias("f"))
    return held, sorted((r.range, r.f.id) for r in first.collect())  # one row a range: at most `most`


def fingerprints_with_next(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", per_range: int = 400, most: int = 10_000) -> DataFrame:
    """One row per row: id, n_chars, edited (its UTF-8), fingerprint, edited_fingerprint, near_edited, near_next."""
    held, heads = _ranges(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")), per_range, most)
    spark = df.sparkSession
    after = [(heads[(i + 1) % len(heads)][1], r) for i, (r, _) in enumerate(heads)]
    guests = spark.createDataFrame(after, "head bigint, host int")
    dealt = held.join(F.broadcast(guests), F.col("id").eqNullSafe(F.col("head")), "left")
    own, guest = F.struct(F.col("range").alias("r"), F.lit(0).alias("g")), F.struct(F.col("host").alias("r"), F.lit(1).alias("g"))
    dealt = dealt.select("id", "t", F.explode(F.when(F.col("host").isNull(), F.array(own)).otherwise(F.array(own, guest))).alias("to"))
    rows = dealt.select("to.r", "to.g", "id", "t").repartition("r").sortWithinPartitions("r", "g", "id", "t")

    def run(rows):
        held = None  # (range, guest, id, Document)
        for whole in batches(rows):
            for at in range(0, whole.num_rows, 256):
                out = []
                for r, g, i, t in zip(*columns_of(whole.slice(at, 256), "r", "g", "id", "t")):
                    if g and (held is None or held[0] != r or held[1]):
                        continue  # only the first guest is anybody's next
                    doc = Document(t)
                    if held is not None and held[0] == r and not held[1]:
                        mine = held[3]
                        raw, other = edited(mine, doc)
                        out.append((held[2], len(mine.text), raw, mine.chain.text(), other.text(), mine.chain.likeness(other), mine.chain.likeness(doc.chain)))
                    held = (r, g, i, doc)
                if out:
                    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.string(), pa.float64(), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    got = rows.mapInArrow(run, "id bigint, n_chars bigint, edited binary, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return got.withColumnRenamed("id", id_col)
