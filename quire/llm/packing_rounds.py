"""Packing whose seeds are scored against the whole corpus: exact, in time that grows with the square of the input.

While more than ``shard_tokens`` tokens are left, rounds of windows are filled.  The seeds of a round (rests of
cut documents, then the next documents that are not used) are scored by BM25 against every unused document: each
task indexes its documents a shard at a time, and the best neighbours are merged over all shards.  The driver
goes through the seeds in order: unused neighbours follow by descending score and fill the window; the one that
does not fit is cut, and its rest seeds a window of the next round.  A list ends when it could fill ``DEPTH``
windows; where earlier seeds have used up such a list, the window stays open and its seed is scored again in the
next round.  Where no neighbour shares a token the next unused document follows.  The last tokens are one shard.

The driver keeps the number and length of every document, so this is for corpora of some million documents at
most; ``packing.pack`` is for all others, and this is what its neighbours are measured against.

Defined results are those of ``packing.pack``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quire.llm.common import batches, columns_of, shared_path, write_shared
from quire.llm.packing import SHARD_TOKENS, WINDOW, ShardIndex, _encoder, _idf, document_frequencies, encode, fill

#: Windows that a list of neighbours could fill; most seeds of a round, and the part of the windows left that it may fill.
DEPTH, BLOCK, PART = 2, 4096, 4


class Rounds:
    """The driver's state of the global fill; documents are numbered from 0 in the order of their rows."""

    def __init__(self, lens: np.ndarray, window: int, keep_back: int):
        self.lens, self.window, self.keep_back = lens, window, keep_back
        self.used, self.next, self.seq = np.zeros(len(lens), bool), 0, 0
        self.unused = int(lens.sum())  # tokens of unused documents
        self.promised = 0  # room of open windows
        self.rests: dict[int, int] = {}  # document -> start of its rest
        self.open: list[list[int]] = []  # [seed, sequence, room]
        self.pieces: list[tuple[int, int, int, int, int]] = []

    def left(self) -> int:
        return self.unused + sum(int(self.lens[d]) - s for d, s in self.rests.items())

    def seeds(self) -> list[int]:
        """Documents to score: those of open windows, rests, the next unused ones; none if one shard can take all."""
        left = self.left()
        n = 0 if left <= self.keep_back else min(BLOCK, max(1, left // self.window // PART))
        out = [w[0] for w in self.open] + [d for d in list(self.rests)[: max(0, n - len(self.open))]]
        if len(out) < n:
            out += (self.next + np.flatnonzero(~self.used[self.next :])[: n - len(out)]).tolist()
        return out

    def _take(self, doc: int, start: int, length: int, seq: int, room: int) -> None:
        self.pieces.append((doc, start, length, seq, self.window - room))

    def _use(self, doc: int) -> None:
        self.used[doc] = True
        self.unused -= int(self.lens[doc])

    def _follow(self, w: list[int], near: list[int], whole: bool) -> bool:
        """Fill a window from its seed's neighbours; whole: the list has all documents that share a token."""
        _, seq, room = w
        self.promised -= room
        near = iter(near)
        while room:
            doc = next((d for d in near if not self.used[d]), -1)
            if doc < 0:
                if not whole:
                    break
                while self.used[self.next]:
                    self.next += 1
                doc = self.next
            self._use(doc)
            take = min(room, int(self.lens[doc]))
            self._take(doc, 0, take, seq, room)
            if take < self.lens[doc]:
                self.rests[doc] = take
            room -= take
        w[2] = room
        self.promised += room
        return not room

    def step(self, seeds: list[int], lists: dict[int, tuple[list[int], bool]]) -> None:
        """One round; lists: document -> its neighbours, best first, and whether these are all."""
        was = len(self.open)
        self.open = [w for w in self.open if not self._follow(w, *lists.get(w[0], ([], True)))]
        for doc in seeds[was:]:
            rest = doc in self.rests
            if self.used[doc] and not rest:
                continue
            at = self.rests[doc] if rest else 0
            own = int(self.lens[doc])
            room = -(own - at) % self.window
            if self.unused - (0 if rest else own) - self.promised < room:
                break  # not enough is left to fill it
            if rest:
                del self.rests[doc]
            else:
                self._use(doc)
            while at < own:
                take = min(self.window, own - at)
                self._take(doc, at, take, self.seq, self.window)
                at, self.seq = at + take, self.seq + 1
            if room:
                w = [doc, self.seq - 1, room]
                self.promised += room
                if not self._follow(w, *lists.get(doc, ([], True))):
                    self.open.append(w)


def _best(scores: np.ndarray, lens: np.ndarray, depth: int) -> np.ndarray:
    """Documents by descending score, the earlier first, until they have ``depth`` tokens."""
    near = np.flatnonzero(scores > 0)
    k = 64
    while k < len(near):  # only the best k, with all ties of the last
        least = np.partition(scores[near], len(near) - k)[len(near) - k]
        some = near[scores[near] >= least]
        if lens[some].sum() >= depth:
            near = some
            break
        k *= 4
    near = near[np.lexsort((near, -scores[near]))]
    total = np.cumsum(lens[near])
    return near[total - lens[near] < depth]


def neighbours(table: DataFrame, number, kind, queries: dict[int, np.ndarray], used: np.ndarray, idf, mean: float, depth: int, shard_tokens: int) -> dict[int, tuple[list[int], bool]]:
    """For each query (document -> its distinct ids) the best unused documents of the whole table."""
    sc = table.sparkSession.sparkContext
    sent = sc.broadcast((queries, np.packbits(used), len(used)))

    def score(rows):
        asked, bits, n = sent.value
        gone = np.unpackbits(bits, count=n).astype(bool)

        def shard(own, doc):
            lens, doc = np.array([len(x) for x in own]), np.array(doc)
            index = ShardIndex(own, idf.value, mean)
            for some in range(0, len(asked), 256):
                q, d, s = [], [], []
                for query in list(asked)[some : some + 256]:
                    got = index.against(asked[query])
                    best = _best(got, lens, depth)
                    q.append(np.full(len(best), query))
                    d.append(doc[best])
                    s.append(got[best])
                d = np.concatenate(d)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(q).astype(np.int64)), pa.array(d.astype(np.int64)), pa.array(np.concatenate(s)), pa.array(all_lens(d, doc, lens))], ["query", "doc", "score", "n"])

        own, docs, tokens = [], [], 0
        for b in batches(rows):
            for d, raw in zip(number(b.column(0).to_numpy()).tolist(), b.column(1).to_pylist()):
                if gone[d]:
                    continue
                own.append(np.frombuffer(raw, kind))
                docs.append(d)
                tokens += len(own[-1])
                if tokens >= shard_tokens:
                    yield from shard(own, docs)
                    own, docs, tokens = [], [], 0
        if own:
            yield from shard(own, docs)

    def all_lens(d, doc, lens):
        order = np.argsort(doc)
        return lens[order][np.searchsorted(doc[order], d)].astype(np.int64)

    found = table.select("row", "ids").mapInArrow(score, "query bigint, doc bigint, score double, n bigint")
    by = Window.partitionBy("query").orderBy(F.desc("score"), "doc").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    got = found.withColumn("total", F.sum("n").over(by)).where(F.col("total") - F.col("n") < depth).select("query", "doc", "total").toArrow()
    sent.unpersist()
    q, d, total = (got[c].to_numpy() for c in ("query", "doc", "total"))
    order = np.lexsort((total, q))
    q, d, total = q[order], d[order], total[order]
    cut = np.append(np.flatnonzero(np.diff(q, prepend=-1)), len(q))
    return {int(q[a]): (d[a:z].tolist(), bool(total[z - 1] < depth)) for a, z in zip(cut[:-1], cut[1:])}


def texts_of(table: DataFrame, number, kind, docs: list[int], distinct: bool) -> dict[int, np.ndarray]:
    """The ids of some documents."""
    sent = table.sparkSession.sparkContext.broadcast(np.sort(np.array(docs, np.int64)))

    def pick(rows):
        for b in batches(rows):
            d = number(b.column(0).to_numpy())
            at = np.flatnonzero(np.isin(d, sent.value))
            raws = b.column(1).take(pa.array(at)).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(d[at]), pa.array([np.unique(np.frombuffer(r, kind)).tobytes() if distinct else r for r in raws], pa.binary())], ["doc", "ids"])

    got = table.select("row", "ids").mapInArrow(pick, "doc bigint, ids binary").toArrow()
    sent.unpersist()
    return {d: np.frombuffer(r, kind) for d, r in zip(got["doc"].to_pylist(), got["ids"].to_pylist())}


def pack(df: DataFrame, tokenizer_path: str, end_id: int = 2, window: int = WINDOW, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per piece: columns ``keep``, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    enc = _encoder(tokenizer_path)
    kind, size = enc.kind, enc.size + 1
    spark, names = df.sparkSession, [f"k{i}" for i in range(len(keep))]
    encoded = write_shared(encode(df, tokenizer_path, end_id, text_col, keep), "packing-ids", "snappy")
    table = encoded.where("row is not null")
    dfs = document_frequencies(encoded, size)
    sizes = table.select("row", "n").toArrow()
    order = np.argsort(sizes["row"].to_numpy())
    rows, lens = sizes["row"].to_numpy()[order], sizes["n"].to_numpy()[order].astype(np.int64)
    part, first = np.unique(rows >> 40, return_index=True)
    starts = np.zeros(int(part[-1]) + 1 if len(part) else 1, np.int64)
    starts[part] = first

    def number(row):
        return starts[row >> 40] + (row & ((1 << 40) - 1))

    idf = _idf(len(lens), dfs)
    mean = float(lens.mean()) if len(lens) else 1.0
    sent = spark.sparkContext.broadcast(idf)
    schema = "row bigint, start bigint, length bigint, sequence_id bigint, offset bigint"
    path = shared_path(spark, "packing-pieces")
    spark.createDataFrame([], schema).write.parquet(path)

    def write(pieces):
        if pieces:
            p = np.array(pieces, np.int64)
            p[:, 0] = rows[p[:, 0]]
            made = pa.table({n: pa.array(p[:, i].copy()) for i, n in enumerate(("row", "start", "length", "sequence_id", "offset"))})
            spark.createDataFrame(made).write.mode("append").parquet(path)

    state = Rounds(lens, window, shard_tokens)
    while seeds := state.seeds():
        before = len(state.open), state.seq
        asked = texts_of(table, number, kind, seeds, True)
        state.step(seeds, neighbours(table, number, kind, asked, state.used, sent, mean, DEPTH * window, shard_tokens))
        stuck = not state.open and state.seq == before[1] and not before[0]
        write(state.pieces)
        state.pieces = []
        if stuck:
            break
    end = sorted({*state.rests, *np.flatnonzero(~state.used).tolist()})
    if end:
        ids = texts_of(table, number, kind, end, False)
        own = [ids[d][state.rests.get(d, 0) :] for d in end]
        pieces = fill(own, ShardIndex(own, idf, mean), window)
        write([(end[d], state.rests.get(end[d], 0) + s, n, state.seq + q, at) for d, s, n, q, at in pieces])

    def cut(batches_in):
        for b in batches(batches_in):
            raw, start, length = columns_of(b, "ids", "start", "length")
            ids = [np.frombuffer(r, kind)[s : s + n].astype("<u4").tobytes() for r, s, n in zip(raw, start, length)]
            yield b.set_column(b.schema.get_field_index("ids"), "ids", pa.array(ids, pa.binary()))

    joined = table.join(spark.read.schema(schema).parquet(path), "row").select(*names, "start", "length", "ids", F.col("n").alias("doc_tokens"), "sequence_id", "offset")
    out = joined.mapInArrow(cut, joined.schema)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep)], "start", "length", "ids", "doc_tokens", "sequence_id", "offset")
