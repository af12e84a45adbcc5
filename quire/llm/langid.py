"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts every n-gram of every labelled training text in Spark; the smoothed log-probability
matrix (languages x 2**bits float32) is broadcast, and documents are scored in batches as sparse rows
(CSR: bucket indices with one slice per document) times that matrix in numpy.

Defined results
* null text, empty text, text without a letter: ``und`` with score 0.
* no labelled training row at all: every document is ``und`` with score 0.
* ties between languages: the first in sorted order of the language values.
* repeated rows are counted, and predicted, once per row; null ids stay null.
* very long texts are worked through in blocks of ``BLOCK`` code points, to the end.
* other columns of the input, whatever their names, are left out of the result.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quire.llm.common import batches, columns_of

UND = "und"
BLOCK = 1 << 18
SALTS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1)


@functools.cache
def _letters() -> np.ndarray:
    """Code point -> its lower-case letter, or 0 where it is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low[0])
    return out


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(texts: list[str | None], orders: tuple[int, ...], bits: int):
    """Yield (row numbers, first bucket of each, buckets) for blocks of whole rows or parts of long rows.

    A part of a long row also holds what follows it, but owns only the n-grams that begin in it.
    """
    gap = max(orders) - 1
    rows: list[int] = []
    parts: list[np.ndarray] = []
    own: list[int] = []
    size = 0

    def emit():
        pad = np.zeros(gap, np.uint32)
        flat = np.concatenate([x for p in parts for x in (p, pad)])
        sizes = np.array([len(p) + gap for p in parts])
        ends = np.cumsum(sizes)
        owned = np.arange(len(flat)) - np.repeat(ends - sizes, sizes) < np.repeat(own, sizes)
        for n in orders:
            h = np.full(len(flat) - gap, n, np.uint32)
            some = np.zeros(len(h), bool)
            for j in range(n):
                c = flat[j : j + len(h)]
                some |= c != 0
                h = (h ^ c) * np.uint32(SALTS[j])
                h ^= h >> np.uint32(15)
            where = np.flatnonzero(some & owned[: len(h)])
            if len(where):
                at = np.searchsorted(ends, where, side="right")
                first = np.flatnonzero(np.diff(at, prepend=-1))
                yield [rows[i] for i in at[first]], first, (h[where] >> np.uint32(32 - bits)).astype(np.int64)

    for i, text in enumerate(texts):
        if not text:
            continue
        cp = _code_points(text)
        for start in range(0, len(cp), BLOCK):
            part = _letters()[cp[start : start + BLOCK + gap]]
            rows.append(i)
            parts.append(part)
            own.append(BLOCK if start + BLOCK < len(cp) else len(part))
            size += len(part)
            if size >= BLOCK:
                yield from emit()
                rows, parts, own, size = [], [], [], 0
    if parts:
        yield from emit()


def _has_letter(text: str | None) -> bool:
    return bool(text) and bool(_letters()[_code_points(text)].any())


def count_features(labelled: DataFrame, text_col: str, lang_col: str, orders=(1, 2, 3), bits: int = 16) -> DataFrame:
    """(lang, bucket, n) over all rows; bucket -1 counts rows."""

    def count(rows):
        held: dict[str, np.ndarray] = {}

        def flush():
            for lang, c in held.items():
                where = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(where), pa.string()), pa.array(where.astype(np.int32) - 1), pa.array(c[where])], ["lang", "bucket", "n"])
            held.clear()

        for b in batches(rows):
            langs, texts = columns_of(b, "lang", "text")
            by: dict[str, list] = {}
            for lang, text in zip(langs, texts):
                by.setdefault(lang, []).append(text)
            for lang, mine in by.items():
                if lang not in held and len(held) >= 64:
                    yield from flush()
                c = held.setdefault(lang, np.zeros((1 << bits) + 1, np.int64))
                c[0] += len(mine)
                for _, _, buckets in _grams(mine, orders, bits):
                    c[1:] += np.bincount(buckets, minlength=1 << bits)
        yield from flush()

    part = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    return part.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    def __init__(self, langs: list[str], weights: np.ndarray, prior: np.ndarray, orders: tuple[int, ...], bits: int):
        self.langs, self.weights, self.prior, self.orders, self.bits = langs, weights, prior, orders, bits

    def predict(self, texts: list[str | None], temper: int = 32) -> tuple[list[str], np.ndarray]:
        n = len(texts)
        if not self.langs:
            return [UND] * n, np.zeros(n)
        total, grams = np.zeros((n, len(self.langs))), np.zeros(n)
        step = max(1, (1 << 22) // len(self.langs))
        for rows, first, buckets in _grams(texts, self.orders, self.bits):
            ends = np.append(first[1:], len(buckets))
            for lo in range(0, len(buckets), step):
                hi = min(lo + step, len(buckets))
                a, z = np.searchsorted(ends, lo, side="right"), np.searchsorted(first, hi, side="left")
                cuts = np.maximum(first[a:z], lo) - lo
                np.add.at(total, rows[a:z], np.add.reduceat(self.weights[buckets[lo:hi]], cuts, axis=0, dtype=np.float64))
            np.add.at(grams, rows, ends - first)
        letters = np.array([_has_letter(t) for t in texts], bool)
        logp = total + self.prior
        best = logp.argmax(axis=1)
        # the posterior as if a text held at most `temper` independent n-grams: long texts do not all score 1
        mean = logp * (np.minimum(grams, temper) / np.maximum(grams, 1))[:, None]
        mean -= mean.max(axis=1, keepdims=True)
        p = np.exp(mean)
        score = p[np.arange(n), best] / p.sum(axis=1)
        return [self.langs[k] if ok else UND for k, ok in zip(best, letters)], np.where(letters, score, 0.0)


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", orders=(1, 2, 3), bits: int = 16, alpha: float = 0.1, max_model_mb: int = 256) -> Model:
    """Count all labelled rows and smooth.  One language takes 4 * 2**bits bytes; a model over max_model_mb is refused."""
    buckets = 1 << bits

    def row(key, t):
        b, n = t["bucket"].to_numpy(), t["n"].to_numpy()
        c = np.zeros(buckets + 1)
        np.add.at(c, b + 1, n)
        w = np.log((c[1:] + alpha) / (c[1:].sum() + alpha * buckets)).astype(np.float32)
        return pa.table({"lang": pa.array([key[0].as_py()], pa.string()), "docs": pa.array([float(c[0])]), "w": pa.array([w.tobytes()], pa.binary())})

    rows = count_features(labelled, text_col, lang_col, tuple(orders), bits).groupBy("lang").applyInArrow(row, "lang string, docs double, w binary")
    most = max_model_mb * 1_000_000 // (4 * buckets)
    got = sorted(rows.limit(most + 1).collect(), key=lambda r: r.lang)
    if len(got) > most:
        raise ValueError(f"more than {most} languages: the log-probability matrix would pass {max_model_mb} MB")
    weights = np.stack([np.frombuffer(r.w, np.float32) for r in got], axis=1) if got else np.zeros((buckets, 0), np.float32)
    docs = np.array([r.docs for r in got])
    return Model([r.lang for r in got], np.ascontiguousarray(weights), np.log((docs + 1) / (docs.sum() + len(got))) if got else docs, tuple(orders), bits)


def identify(df: DataFrame, model: Model, text_col: str = "text", keep: dict | None = None, text_in: str | None = None) -> DataFrame:
    """Columns of ``keep`` (name -> Column), then lang_pred and score.  text_in: which of ``keep`` is the text, if one is; it is held once then."""
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast(model)
    keep = keep or {"doc_id": F.col("doc_id")}
    names = [f"k{i}" for i in range(len(keep))]
    text = names[list(keep).index(text_in)] if text_in else "_t"
    part = df.select(*[c.alias(n) for n, c in zip(names, keep.values())], *([] if text_in else [F.col(text_col).alias(text)]))
    fields = ", ".join(f"{n} {part.schema[n].dataType.simpleString()}" for n in names)

    def score(rows):
        for b in batches(rows):
            langs, p = sent.value.predict(columns_of(b, text)[0])
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(names))], pa.array(langs, pa.string()), pa.array(p, pa.float64())], [*names, "lang_pred", "score"])

    out = part.mapInArrow(score, f"{fields}, lang_pred string, score double")
    return out.select(*[F.col(n).alias(k) for n, k in zip(names, keep)], "lang_pred", "score")


def held_out(doc_id: Column) -> Column:
    """The fold kept out of training: crc32 of the id's text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))
