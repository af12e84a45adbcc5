"""Quality rules: counted text rules, then bands of n-gram perplexity per language.

The language model is a modified Kneser-Ney model of byte n-grams (A-Z lower-cased, words joined by one
blank), counted by Spark over all texts.  A key holds the n-gram's bytes, so it is a collision-free hash;
the model is one sorted key array per order, with log-probabilities and back-off weights beside it.

Scoring looks keys up by binary search in a broadcast model while the model has at most ``max_broadcast``
n-grams (12 to 16 bytes each); beyond that the same sums are made by joins on the keys.  Both ways give
the same figures.

Bands: per language, the quartiles of the log-perplexity of all texts that pass the counted rules (from an
exact histogram in steps of ``STEP``), widened below and above by ``spread`` times their distance and by
``short`` over the square root of the text's bytes, as the mean over a short text scatters that much more.

Defined results: a null text has no words; texts without words have no perplexity (null) and fail the
counted rules; a null language is a language of its own, as is one that no text with words has; ties and
repeated rows are judged alike; other input columns are left out.  An empty table gives no row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quire.llm.common import batches, columns_of, kept, utf8, write_shared
from quire.llm.word_hash import WordHash, runs

ORDER, STEP = 5, 0.002
_BLOCK = 1_000_000
_DOC_BITS = 64 - 8 * ORDER


def normal(text: str | None) -> bytes:
    """What the model reads: the words in lower case, with blanks for the missing context in front."""
    return b" " * (ORDER - 1) + b" ".join(utf8(text).lower().split())


def _keys(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all n-grams of the parts, and the part of each."""
    b = np.frombuffer(b"".join(parts), np.uint8)
    n = len(b) - ORDER + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(ORDER):
        key <<= np.uint64(8)
        key |= b[j : j + n]
    sizes = np.array([len(p) for p in parts])
    part = np.repeat(np.arange(len(parts), dtype=np.uint64), sizes)[ORDER - 1 :]
    inside = (np.arange(len(b)) - np.repeat(np.cumsum(sizes) - sizes, sizes))[ORDER - 1 :] >= ORDER - 1
    return key[inside], part[inside]


def _blocks(texts):
    """Lists of (index, part); a long text comes in parts that overlap by the context."""
    held, size = [], 0
    for i, t in enumerate(texts):
        b = normal(t)
        for at in range(0, max(1, len(b) - ORDER + 1), _BLOCK):
            p = b[at : at + _BLOCK + ORDER - 1]
            held.append((i, p))
            size += len(p)
            if size >= _BLOCK:
                yield held
                held, size = [], 0
    if held:
        yield held


def count_ngrams(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(key, n): every n-gram of the highest order, over all rows."""

    def count(rows):
        for b in batches(rows):
            for block in _blocks(columns_of(b, "t")[0]):
                key, n = np.unique(_keys([p for _, p in block])[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

    return df.select(F.col(text_col).alias("t")).mapInArrow(count, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def _suffix(order: int) -> Column:
    return F.col("key").bitwiseAND(F.lit((1 << 8 * order) - 1))


def discounts(counts: dict[int, int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of n-grams seen once to four times."""
    n1, n2, n3, n4 = (counts.get(i, 0) for i in (1, 2, 3, 4))
    if not (n1 and n2 and n3):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return tuple(min(max(x, 0.05), i - 0.05) for i, x in enumerate(d, 1))


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(ord, key, logp, backoff): backoff is the log weight of the n-gram as a context, null if it is none."""
    top = write_shared(counts, "ngrams")
    levels = {ORDER: top}
    for k in range(ORDER - 1, 0, -1):  # continuation counts: distinct left neighbours
        levels[k] = levels[k + 1].groupBy(_suffix(k).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    tally = None
    for k, t in levels.items():
        c = t.where("n <= 4").groupBy("n").agg(F.count(F.lit(1)).alias("types")).select(F.lit(k).alias("k"), "n", "types")
        tally = c if tally is None else tally.union(c)
    by: dict[int, dict[int, int]] = {}
    for r in tally.collect():  # at most four rows an order
        by.setdefault(r.k, {})[r.n] = r.types
    below, out = None, None
    for k in range(1, ORDER + 1):
        d1, d2, d3 = discounts(by.get(k, {}))
        t = levels[k].select("key", "n", F.shiftright("key", 8).alias("ctx"))
        off = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        ctx = t.groupBy("ctx").agg(F.sum("n").alias("total"), F.sum(off).alias("left"))
        t = t.join(ctx, "ctx").select("key", "ctx", ((F.col("n") - off) / F.col("total")).alias("p"), (F.col("left") / F.col("total")).alias("gamma"))
        if below is None:
            t = t.withColumn("p", F.col("p") + F.col("gamma") / 256)
        else:
            lower = below.select(F.col("key").alias("s"), F.col("p").alias("q"))
            t = t.join(lower, _suffix(k - 1) == F.col("s")).select("key", "ctx", (F.col("p") + F.col("gamma") * F.col("q")).alias("p"), "gamma")
        t = write_shared(t.select("key", "p", "ctx", "gamma"), f"kn{k}")
        rows = t.select(F.lit(k).alias("ord"), "key", F.log("p").cast("float").alias("logp"))
        weights = t.select(F.lit(k - 1).alias("ord"), F.col("ctx").alias("key"), F.log("gamma").cast("float").alias("backoff")).distinct()
        out = (rows, weights) if out is None else (out[0].union(rows), out[1].union(weights))
        below = t
    return out[0].join(out[1], ["ord", "key"], "full")


class Arrays:
    """The model as sorted key arrays per order."""

    def __init__(self, t: pa.Table):
        o, key = t["ord"].to_numpy(), t["key"].to_numpy().view(np.uint64)
        p, b = (t[c].to_numpy().astype(np.float32) for c in ("logp", "backoff"))
        self.levels = {}
        for k in range(ORDER + 1):
            at = np.flatnonzero(o == k)
            at = at[np.argsort(key[at])]
            self.levels[k] = key[at], p[at], b[at]

    def _find(self, k: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = self.levels[k][0]
        if not len(keys):
            return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return at, keys[at] == key

    def logp(self, key: np.ndarray) -> np.ndarray:
        """Log-probability of the last byte of each n-gram after the others; the keys need no order."""
        out, todo, weight = np.zeros(len(key)), np.arange(len(key)), np.zeros(len(key))
        for k in range(ORDER, 0, -1):
            at, ok = self._find(k, key[todo] & np.uint64((1 << 8 * k) - 1))
            p = self.levels[k][1][at] if len(self.levels[k][1]) else np.zeros(len(at))
            ok &= ~np.isnan(p)
            out[todo[ok]] = weight[todo[ok]] + p[ok]
            todo = todo[~ok]
            if not len(todo):
                return out
            at, ok = self._find(k - 1, (key[todo] & np.uint64((1 << 8 * k) - 1)) >> np.uint64(8))
            if ok.any():
                weight[todo[ok]] += np.nan_to_num(self.levels[k - 1][2][at[ok]])
        out[todo] = weight[todo] - math.log(256)
        return out


def text_rules(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = utf8(text)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated = 0
    if len(words) > 8:
        known = kept("words", WordHash).known
        w = runs(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)), 8)
        s = np.sort(w)
        twice = s[1:][s[1:] == s[:-1]]
        if len(twice):
            start = np.flatnonzero(np.isin(w, twice))
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, start, 1)
            np.add.at(edge, start + 8, -1)
            repeated = int((np.cumsum(edge)[:-1] > 0).sum())
    return len(words), len(text) - len(raw) + sum(map(len, words)), len(raw) - len(raw.translate(None, b"#*$%&|<>")), len(lines) - len(set(lines)), repeated


def _per_part(block, lookup) -> tuple[np.ndarray, np.ndarray]:
    key, part = _keys([p for _, p in block])
    x = np.sort(key << np.uint64(_DOC_BITS) | part)
    first = np.flatnonzero(np.diff(x, prepend=~x[:1])) if len(x) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(x)))
    u, where = x[first] >> np.uint64(_DOC_BITS), (x[first] & np.uint64((1 << _DOC_BITS) - 1)).astype(np.int64)
    return lookup(u, where, n)


_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def score(df: DataFrame, model: DataFrame, text_col: str, keep: dict[str, Column], max_broadcast: int = 4_000_000, text_in: str | None = None) -> DataFrame:
    """Columns ``keep``, the counted rules, n_bytes, and log_ppl: the mean negative log-probability of a byte.

    text_in: which of ``keep`` is the text, if one is; it is held once then."""
    names = [f"k{i}" for i in range(len(keep))]
    text = names[list(keep).index(text_in)] if text_in else "t"
    part = df.select(*[c.alias(n) for n, c in zip(names, keep.values())], *([] if text_in else [F.col(text_col).alias(text)]))
    fields = "".join(f"{n} {part.schema[n].dataType.simpleString()}, " for n in names)
    stats = "".join(f"{s} bigint, " for s in _STATS)
    small = model.limit(max_broadcast + 1).count() <= max_broadcast
    sent = df.sparkSession.sparkContext.broadcast(Arrays(model.toArrow())) if small else None

    def run(rows):
        for b in batches(rows):
            texts = columns_of(b, text)[0]
            counted = list(zip(*map(text_rules, texts)))
            total, size = np.zeros(len(texts)), np.zeros(len(texts))
            for block in _blocks(texts):
                index = np.array([i for i, _ in block])

                def add(u, where, n):
                    new = np.flatnonzero(np.diff(u, prepend=~u[:1]))  # sorted: one look-up a key
                    logp = np.repeat(sent.value.logp(u[new]), np.diff(np.append(new, len(u))))
                    np.add.at(total, index[where], n * logp)
                    np.add.at(size, index[where], n)

                _per_part(block, add)
            ppl = [-t / n if n else None for t, n in zip(total, size)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], *[pa.array(c, pa.int64()) for c in counted], pa.array(size.astype(np.int64)), pa.array(ppl, pa.float64())], [*names, *_STATS, "n_bytes", "log_ppl"])

    def explode(rows):
        for whole in batches(rows):
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                texts = columns_of(b, text)[0]
                counted = list(zip(*map(text_rules, texts)))
                keys, ns, ends = [], [], [0]
                for t in texts:
                    found = [np.unique(_keys([p for _, p in block])[0], return_counts=True) for block in _blocks([t])]
                    keys += [k for k, _ in found]
                    ns += [n for _, n in found]
                    ends.append(ends[-1] + sum(len(k) for k, _ in found))
                grams = pa.StructArray.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(ns).astype(np.int64))], ["key", "n"])
                yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], *[pa.array(c, pa.int64()) for c in counted], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), grams)], [*names, *_STATS, "grams"])

    if small:
        out = part.mapInArrow(run, f"{fields}{stats}n_bytes bigint, log_ppl double")
    else:
        rows = part.mapInArrow(explode, f"{fields}{stats}grams array<struct<key bigint, n bigint>>").withColumn("row", F.expr("uuid()"))
        rows = write_shared(rows, "ngrams-by-text")
        todo = rows.select("row", F.explode("grams").alias("g")).select("row", F.col("g.key").alias("key"), F.col("g.n").alias("n"), F.lit(0.0).alias("w"))
        sums = None
        for k in range(ORDER, 0, -1):
            level = model.where(F.col("ord") == k).where("logp is not null").select(F.col("key").alias("mk"), "logp")
            got = todo.join(level, _suffix(k) == F.col("mk"), "left")
            hit = got.where("mk is not null").select("row", "n", (F.col("n") * (F.col("w") + F.col("logp"))).alias("s"))
            sums = hit if sums is None else sums.union(hit)
            ctx = model.where(F.col("ord") == k - 1).where("backoff is not null").select(F.col("key").alias("ck"), "backoff")
            todo = got.where("mk is null").join(ctx, F.shiftright(_suffix(k), 8) == F.col("ck"), "left").select("row", "key", "n", (F.col("w") + F.coalesce("backoff", F.lit(0.0))).alias("w"))
        sums = sums.union(todo.select("row", "n", F.col("n") * (F.col("w") - math.log(256))))
        ppl = sums.groupBy("row").agg(F.sum("n").alias("n_bytes"), (-F.sum("s") / F.sum("n")).alias("log_ppl"))
        out = rows.drop("grams").join(ppl, "row", "left").withColumn("n_bytes", F.coalesce("n_bytes", F.lit(0)))
    return out.select(*[F.col(n).alias(k) for n, k in zip(names, keep)], *_STATS, "n_bytes", "log_ppl")


def bands(scored: DataFrame) -> DataFrame:
    """(band_lang, q1, q3): quartiles of log_ppl over rows that passed the counted rules."""
    hist = scored.where("not base_failed and log_ppl is not null").groupBy("lang", F.floor(F.col("log_ppl") / STEP).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("lang")  # at most log(256) / STEP bins and a few more
    h = hist.withColumns({"up": F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("n").over(w)})
    q1, q3 = (F.min(F.when(F.col("up") >= f * F.col("total"), F.col("bin"))) * STEP for f in (0.25, 0.75))
    return h.groupBy("lang").agg(q1.alias("q1"), (q3 + STEP).alias("q3")).withColumnRenamed("lang", "band_lang")


def judge(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang", spread: tuple[float, float] = (3.0, 2.0), short: tuple[float, float] = (6.0, 3.0), least: float = 0.02, max_broadcast: int = 4_000_000, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id, lang, the counted rules, base_failed, perplexity, its band, kept; with ``keep``: these columns and kept."""
    model = write_shared(kneser_ney(count_ngrams(df, text_col)), "kneser-ney")
    scored = score(df, model, text_col, {"id": F.col(id_col), "lang": F.col(lang_col).cast("string")} | {f"own{i}": F.col(c) for i, c in enumerate(keep)}, max_broadcast, f"own{keep.index(text_col)}" if text_col in keep else None)
    scored = write_shared(scored.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))), "quality")
    out = scored.join(bands(scored), F.col("lang").eqNullSafe(F.col("band_lang")), "left")
    wide, scatter = F.greatest(F.col("q3") - F.col("q1"), F.lit(least)), F.sqrt(F.greatest(F.col("n_bytes"), F.lit(1)))
    out = out.withColumns({"lower": F.col("q1") - spread[0] * wide - short[0] / scatter, "upper": F.col("q3") + spread[1] * wide + short[1] / scatter})
    inside = F.coalesce(F.col("log_ppl").between(F.col("lower"), F.col("upper")), F.lit(False))
    if keep:
        return out.select(*[F.col(f"own{i}").alias(c) for i, c in enumerate(keep)], (~F.col("base_failed") & inside).alias("kept"))
    return out.select(F.col("id").alias(id_col), *_STATS, "base_failed", (~F.col("base_failed") & inside).alias("kept"), "lang", F.exp("log_ppl").alias("perplexity"), F.exp("lower").alias("lower"), F.exp("upper").alias("upper"))
