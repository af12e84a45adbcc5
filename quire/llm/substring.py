"""Exact substring de-duplication over a log-structured fingerprint index.

A window is ``width`` consecutive words.  Every word that lies in a window whose words also start
anywhere else (the same document included) is removed; windows are judged on the input.

1. Documents are packed into chunks.  Of each window only the least hash of its ``width - gram + 1`` word grams
   is indexed (a minimizer: equal windows have equal minimizers), about 7 % of the words.
2. ``substring_index.Index`` takes the chunks batch by batch: each batch brings a sorted immutable run, which is
   merge-joined with the historical runs; runs are compacted.  It tells which hashes came again, and where.
3. Verification.  Only windows whose minimizer came again bring fingerprints, 96 bits of two independent
   hashes.  Each chunk's are dealt by hash range (``PER_SHARD``); a range sorts and merges those of all chunks and
   answers each with a bit per fingerprint.  Windows found again there are removed.

``remove_repeats`` passes a table through an index of its own in ``BATCHES`` batches and judges all documents
alike.  ``Index.append`` removes from new documents what they repeat of older ones.

Scale: a frequent passage is one entry per chunk however often the chunk has it; text crosses the network once,
compressed, and again for candidate documents only.  A single document is handled by one task.

Defined results: null or empty text has 0 words and keeps the empty string; fewer than ``width`` words:
nothing is removed; the removal does not depend on the order of rows; repeated rows are copies of each
other like any others, each gets a row; ids may be null.  Columns not named in ``keep`` are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from quire.llm.common import batches, kept, shared_path, utf8, write_shared
from quire.llm.word_hash import BASES, WordHash, runs, sliding_min

WIDTH, GRAM = 35, 8
#: Text bytes of a chunk, fingerprints of a hash range in verification, batches of a table.
CHUNK_BYTES, PER_SHARD, BATCHES = 4_000_000, 2_000_000, 3
CHUNK = "chunk bigint, docs binary, mins binary, twice binary, lens binary"
_RUN = "shard int, chunk bigint, k binary, x binary, many binary"
_WORD = re.compile(rb"[^ \t-\r]+")


def _hasher() -> WordHash:
    return kept("words", WordHash)


def _pack(t: pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(t)
    return out.getvalue().to_pybytes()


def _unpack(raw: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(raw).read_next_batch()


def _finish(text: str | None, keep: np.ndarray | None, digest: bool):
    """SHA-256 of the kept words joined by one blank, or the text without the removed words and what follows each."""
    raw = utf8(text)
    if digest:
        words = raw.split()
        if keep is not None:
            words = [w for w, k in zip(words, keep.tolist()) if k]
        return hashlib.sha256(b" ".join(words)).hexdigest()
    if keep is not None and not keep.all():
        starts = [m.start() for m in _WORD.finditer(raw)] + [len(raw)]
        raw = raw[: starts[0]] + b"".join([raw[a:z] for a, z, k in zip(starts, starts[1:], keep.tolist()) if k])
        raw = raw.strip()
    return raw.decode("utf-8", "surrogatepass")


def _u64(raw: bytes | None) -> np.ndarray:
    return np.frombuffer(raw or b"", np.uint64)


# ---- sorted runs and their merge


def _run_rows(chunk: int, k: np.ndarray, x: np.ndarray | None, many: np.ndarray, shards: int) -> Iterator[tuple]:
    """The entries of one chunk by shard, in their order."""
    shard = (k >> np.uint64(33)) % np.uint64(shards)
    for s in np.unique(shard).tolist() if shards > 1 else [0] * bool(len(k)):
        at = shard == s
        yield s, chunk, k[at].tobytes(), b"" if x is None else x[at].tobytes(), np.packbits(many[at]).tobytes()


def _as_runs(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 5
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["shard", "chunk", "k", "x", "many"])


def merge_runs(k: np.ndarray, x: np.ndarray | None, many: np.ndarray) -> np.ndarray:
    """For each entry, whether an equal one exists (or it stands for several itself)."""
    s = np.sort(k)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return many.copy()
    at = np.searchsorted(twice, k)
    at[at == len(twice)] = 0
    found = twice[at] == k
    if x is not None:  # verify: the second hash must agree as well
        i = np.flatnonzero(found)
        i = i[np.lexsort((x[i], k[i]))]
        same = (k[i][1:] == k[i][:-1]) & (x[i][1:] == x[i][:-1])
        found[:] = False
        found[i[1:][same]] = True
        found[i[:-1][same]] = True
    return found | many


def _shard_answers(t):
    """One shard: all its runs in, a bitmap for each run out."""
    ks = [_u64(r) for r in t["k"].to_pylist()]
    xs = [np.frombuffer(r, np.uint32) for r in t["x"].to_pylist()]
    k = np.concatenate(ks)
    x = np.concatenate(xs)
    many = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=len(a)).astype(bool) for m, a in zip(t["many"].to_pylist(), ks)])
    found = merge_runs(k, x if len(x) else None, many)
    ends = np.cumsum([len(a) for a in ks])
    bits = [np.packbits(found[e - len(a) : e]).tobytes() for a, e in zip(ks, ends)]
    return pa.table({"chunk": t["chunk"], "shard": t["shard"], "bits": pa.array(bits, pa.binary())})


def _answers(run_rows: DataFrame) -> DataFrame:
    """chunk -> answers (array of shard and bitmap)."""
    got = run_rows.groupBy("shard").applyInArrow(_shard_answers, "chunk bigint, shard int, bits binary")
    return got.groupBy("chunk").agg(F.collect_list(F.struct("shard", "bits")).alias("answers"))


def _found(answers, k: np.ndarray, shards: int) -> np.ndarray:
    shard = (k >> np.uint64(33)) % np.uint64(shards)
    out = np.zeros(len(k), bool)
    for a in answers or ():
        at = np.flatnonzero(shard == a["shard"])
        out[at] = np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=len(at)).astype(bool)
    return out


def _shards(rows: DataFrame, col) -> int:
    n = rows.agg(F.sum(col)).first()[0] or 0
    return max(1, -(-int(n) // PER_SHARD))


# ---- chunks and their entries


def _minimizers(h: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted minimizers of a document, and whether each gram stands in it more than once."""
    if len(h) < width:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    g = runs(h, gram)
    u = np.unique(sliding_min(g, width - gram + 1))
    s = np.sort(g)
    twice = s[1:][s[1:] == s[:-1]]
    return u, np.isin(u, twice)


def chunks_of(df: DataFrame, text_col: str, keep: tuple[str, ...], width: int, gram: int) -> DataFrame:
    """``CHUNK``: documents packed (k0, k1, ..., text, number of words), with their minimizers."""
    names = [f"k{i}" for i in range(len(keep))]
    part = df.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.col(text_col).alias("_t"))

    def pack(held: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
        b = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        words = _hasher()
        hashes = [words(t) for t in b.column(len(names)).to_pylist()]
        found = [_minimizers(h, width, gram) for h in hashes]
        docs = pa.RecordBatch.from_arrays([*b.columns, pa.array([len(h) for h in hashes], pa.int64())], [*names, "_t", "_n"])
        mins, twice = np.concatenate([m for m, _ in found]), np.concatenate([t for _, t in found])
        raws = (_pack(docs), mins.tobytes(), np.packbits(twice).tobytes(), np.array([len(m) for m, _ in found], np.uint32).tobytes())
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *[pa.array([r], pa.binary()) for r in raws]], ["chunk", "docs", "mins", "twice", "lens"])

    def load(rows):
        number, held, size = TaskContext.get().partitionId() << 24, [], 0
        for whole in batches(rows):
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                held.append(b)
                size += b.nbytes
                if size >= CHUNK_BYTES:
                    yield pack(held, number)
                    number, held, size = number + 1, [], 0
        if held:
            yield pack(held, number)

    return part.mapInArrow(load, CHUNK)


def entries(chunks: DataFrame) -> DataFrame:
    """(k, chunk, many): each distinct minimizer of a chunk, and whether it stands there more than once."""

    def flat(rows):
        for b in batches(rows):
            for chunk, mins, twice in zip(*(c.to_pylist() for c in b.columns)):
                v = _u64(mins)
                t = np.unpackbits(np.frombuffer(twice, np.uint8), count=len(v)).astype(bool)
                u, n = np.unique(v, return_counts=True)
                many = (n > 1) | np.isin(u, v[t])
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(np.full(len(u), chunk)), pa.array(many)], ["k", "chunk", "many"])

    return chunks.select("chunk", "mins", "twice").mapInArrow(flat, "k bigint, chunk bigint, many boolean")


# ---- verification and removal


def _candidates(h: np.ndarray, wanted: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and fingerprints of the windows whose minimizer is wanted (sorted)."""
    if len(h) < width or not len(wanted):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    m = sliding_min(runs(h, gram), width - gram + 1)
    at = np.searchsorted(wanted, m)
    at[at == len(wanted)] = 0
    start = np.flatnonzero(wanted[at] == m)
    return start, runs(h, width)[start], (runs(h, width, BASES[1])[start] >> np.uint64(32)).astype(np.uint32)


def _windows(docs: pa.RecordBatch, wanted: np.ndarray, width: int, gram: int):
    words = _hasher()
    got = [_candidates(words(t), wanted, width, gram) for t in docs.column("_t").to_pylist()]
    return got, np.concatenate([g[1] for g in got]), np.concatenate([g[2] for g in got])


def _hits(mins: bytes, lens: bytes, wanted: np.ndarray) -> np.ndarray:
    """For each document of a chunk, how many of its minimizers are wanted."""
    sizes = np.frombuffer(lens, np.uint32).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(np.isin(_u64(mins), wanted))])
    at = np.cumsum(sizes)
    return ends[at] - ends[at - sizes]


def remove(chunks: DataFrame, found: DataFrame, kinds: list[str], width: int, gram: int, digest: bool, others: DataFrame | None = None) -> DataFrame:
    """The documents of chunks without their repeated words, verified among themselves and with ``others``.

    found: (chunk, k) of the minimizers that came again; kinds: names and types of the documents' own columns."""
    names = [f"k{i}" for i in range(len(kinds))]
    fields = ", ".join(f"{n} {k.split(' ', 1)[1]}" for n, k in zip(names, kinds))
    wanted = found.groupBy("chunk").agg(F.collect_set("k").alias("wanted"))  # within a chunk
    all_chunks = chunks.withColumn("own", F.lit(True))
    if others is not None:
        all_chunks = all_chunks.union(others.withColumn("own", F.lit(False)))
    out_names = [*names, "n_words", "n_removed", "kept", "chunk", "docs", "wanted", "most", "own"]

    def settle(rows):
        """Documents without a candidate window are done; the others go on, packed, with what was found."""
        for b in batches(rows):
            *_, own_col, lists = b.columns
            for i, (chunk, packed, mins, lens, own) in enumerate(zip(*(c.to_pylist() for c in b.columns[:4]), own_col.to_pylist())):
                ks = lists[i].values
                some = np.sort(ks.to_numpy().view(np.uint64)) if ks is not None else np.zeros(0, np.uint64)
                docs, open_ = _unpack(packed), _hits(mins, lens, some) > 0
                if own and not open_.all():
                    done = docs.filter(pa.array(~open_))
                    n, kept = done.num_rows, [_finish(t, None, digest) for t in done.column("_t").to_pylist()]
                    tail = [pa.nulls(n, t) for t in (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_())]
                    yield pa.RecordBatch.from_arrays([*done.columns[: len(names)], done.column("_n"), pa.array([0] * n, pa.int64()), pa.array(kept, pa.string()), *tail], out_names)
                if open_.any():
                    docs = docs.filter(pa.array(open_))
                    most = int(np.maximum(np.asarray(docs.column("_n")) - width + 1, 0).sum())
                    head = [*[pa.nulls(1, docs.schema.field(j).type) for j in range(len(names))], pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.string())]
                    tail = (pa.array([chunk], pa.int64()), pa.array([_pack(docs)], pa.binary()), pa.array([some.tobytes()], pa.binary()), pa.array([most], pa.int64()), pa.array([own]))
                    yield pa.RecordBatch.from_arrays([*head, *tail], out_names)

    joined = all_chunks.select("chunk", "docs", "mins", "lens", "own").join(wanted, "chunk", "left")
    schema = f"{fields}, n_words bigint, n_removed bigint, kept string, chunk bigint, docs binary, wanted binary, most bigint, own boolean"
    settled = write_shared(joined.mapInArrow(settle, schema), "substring-settled")
    rest = settled.where("chunk is not null")
    shards = _shards(rest, F.col("most"))

    def dense(rows):
        for b in batches(rows):
            for chunk, packed, want in zip(*(c.to_pylist() for c in b.columns)):
                _, k, x = _windows(_unpack(packed), _u64(want), width, gram)
                yield _as_runs(list(_run_rows(chunk, k, x, np.zeros(len(k), bool), shards)))

    second = _answers(rest.select("chunk", "docs", "wanted").mapInArrow(dense, _RUN))

    def cut(rows):
        for b in batches(rows):
            for packed, want, answers in zip(*(c.to_pylist() for c in b.columns)):
                docs = _unpack(packed)
                got, k, _ = _windows(docs, _u64(want), width, gram)
                hit, at, removed, kept = _found(answers, k, shards), 0, [], []
                for text, n, (start, _, _) in zip(docs.column("_t").to_pylist(), docs.column("_n").to_pylist(), got):
                    s = start[hit[at : at + len(start)]]
                    at += len(start)
                    stay = covered(s, n, width) if len(s) else None
                    removed.append(0 if stay is None else int(n - stay.sum()))
                    kept.append(_finish(text, stay, digest))
                yield pa.RecordBatch.from_arrays([*docs.columns[: len(names)], docs.column("_n"), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], [*names, "n_words", "n_removed", "kept"])

    own = rest.where("own").select("chunk", "docs", "wanted")
    last = own.join(second, "chunk", "left").select("docs", "wanted", "answers").mapInArrow(cut, f"{fields}, n_words bigint, n_removed bigint, kept string")
    every = settled.where("chunk is null").select(*names, "n_words", "n_removed", "kept").unionByName(last)
    return every.select(*[F.col(n).alias(k.split(" ", 1)[0]) for n, k in zip(names, kinds)], "n_words", "n_removed", "kept")


def covered(starts: np.ndarray, n: int, width: int) -> np.ndarray:
    """Which of n words no window covers."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return np.cumsum(edge)[:n] == 0


def remove_repeats(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), width: int = WIDTH, gram: int = GRAM, digest: bool = False, batch_count: int = BATCHES) -> DataFrame:
    """Columns ``keep``, n_words, n_removed and kept: the text without the removed words, or with ``digest`` the SHA-256
    of the kept words joined by one blank."""
    from quire.llm.substring_index import Index

    index = Index(df.sparkSession, shared_path(df.sparkSession, "substring-index"), width, gram)
    chunks = write_shared(index.load(df, text_col, keep), "substring-chunks")
    for i in range(batch_count):
        index.add(chunks.where(F.pmod("chunk", F.lit(batch_count)) == i), str(i))
    found = index.found()
    index.close()
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields]
    return remove(chunks, found, kinds, width, gram, digest)
