"""Lexical retrieval packing: a seed document's BM25 neighbours fill its window.

1. A bounded sample of ``SAMPLE`` documents fits ``CELLS`` cells (spherical k-means over randomly projected,
   idf-weighted token vectors).  The sample serves for nothing else.
2. One pass encodes every text (word BPE from a tokenizer file, then an end id), finds its cell, and counts the
   documents that hold each id.  Frequencies and mean length of BM25 are of all documents.
3. The inverted index is sharded by content: a bin is a cell and a min-hash of the document's ids, bins in
   order (neighbouring cells follow each other) make shards of ``SHARD_TOKENS`` tokens, and a bin beyond that,
   such as a group of copies, is dealt over several.  So documents that resemble each other share a shard.
4. In each shard the next unused document is a seed; its neighbours by descending BM25 follow and fill its
   window.  The one that does not fit is cut and goes on in the next window.  Where no unused neighbour shares
   a token the next unused document follows.
5. All windows are full but the last tokens of a shard, which go into sequences of falling powers of two.
   So there is no padding where a sequence is padded to the window unless its length is a power of two.

Time and shuffle grow in proportion to the input.  A seed's candidates are all unused documents of its own
shard, those of the others are not scored; ``packing_rounds`` scores every seed against the whole corpus, in
time that grows with the square of the input.

Defined results: null text counts as empty and is one piece, the end id; a document longer than a window
fills several; ties of score go to the earlier row; repeated rows and null ids are documents of their
own; an empty table gives no row; columns not named in ``keep`` are left out.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from quire.llm.chunks import LONGEST, Cache
from quire.llm.common import batches, kept, write_shared
from quire.llm.merges import Merges

WINDOW, SHARD_TOKENS = 4096, 2_000_000
#: Documents that fit the cells, cells, dimensions of a projected vector, min-hash classes of a cell.
SAMPLE, CELLS, DIMS, CLASSES = 16_384, 256, 64, 64
#: Bytes of text, and rows, that are encoded at a time.
BLOCK, SLICE = 8_000_000, 2048
#: Chunks for which lower-casing and normalisation go letter by letter: printable ASCII and precomposed Latin.
_PLAIN = re.compile("[!-~\xa1-\u012f\u0131-\u024f]*").fullmatch
#: The same Latin letters, without U+0130, whose lower case is no letter alone.
_LATIN = "^[!-~\u00a1-\u012f\u0131-\u024f]*$"
_SPACE = re.compile("[ \t-\r]")


def _strings(a: pa.Array) -> list:
    return a.to_numpy(zero_copy_only=False).tolist()


def _parts(texts: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """The texts in blocks of about ``BLOCK`` bytes, with the row of each entry; a longer text is cut at white space."""
    held, rows, size = [], [], 0
    for i, t in enumerate(_strings(texts)):
        t, lo = t or "", 0
        while lo < len(t) or not lo:
            cut = _SPACE.search(t, lo + BLOCK) if len(t) - lo > BLOCK else None
            hi = cut.end() if cut else len(t)
            held.append(t[lo:hi])
            rows.append(i)
            size += hi - lo
            lo = max(hi, 1)
            if size >= BLOCK:
                yield pa.array(held, pa.large_string()), np.array(rows)
                held, rows, size = [], [], 0
    if held:
        yield pa.array(held, pa.large_string()), np.array(rows)


class WordEncoder:
    """Token ids of texts by a tokenizer file (lower-casing, white space dropped, BPE with word ends).

    No token crosses white space, so a block of texts is split there, and each distinct chunk of the block
    is looked at once.  Those that are a word of Latin letters, maybe with a full stop or comma after it, are
    lower-cased together, and the words that the cache does not know are merged together.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.size = self.whole.get_vocab_size()
        self.kind = np.uint16 if self.size < 1 << 16 else np.uint32
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the byte-level alphabet
        hidden = iter(range(256, 512))
        self.letter = {b: chr(b) if b in shown else chr(next(hidden)) for b in range(256)}
        self.known = Cache(self._piece, 1_000_000)
        self.chunks = Cache(self._chunk, 200_000)
        self.marks = [int(np.frombuffer(self.known[m], self.kind)[0]) for m in (",", ".")]  # each is one id
        self.merges = None
        if self.kind is np.uint16:
            with open(path, encoding="utf-8") as f:
                model = json.load(f)["model"]
            ids = model["vocab"]
            self.merges = Merges([(ids[a], ids[b], ids[a + b]) for a, b in model["merges"]])
            self.first, self.last = (np.array([ids[self.letter[b] + end] for b in range(256)], np.uint16) for end in ("", "</w>"))

    def _piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else "".join(map(self.letter.__getitem__, piece.encode()))
        return np.array([t.id for t in self.model.tokenize(shown)], self.kind).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if not _PLAIN(chunk) or "<|" in chunk:
            return np.array(self.whole.encode(chunk, add_special_tokens=False).ids, self.kind).tobytes()
        return b"".join([self.known[p] for p in self.pieces(chunk.lower())])

    def _learn(self, words: list[str]) -> None:
        """Put the words that the cache lacks in it."""
        known = self.known
        old = known.old
        new = [w for w in words if w not in known and w not in old]
        if self.merges is None or len(new) < 64:
            return
        raw = [w.encode() for w in new]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        for n in np.unique(size[size <= LONGEST]).tolist():
            at = np.flatnonzero(size == n).tolist()
            b = np.frombuffer(b"".join([raw[i] for i in at]), np.uint8).reshape(-1, n)
            s = self.first[b]
            s[:, -1] = self.last[b[:, -1]]
            for row, ids in self.merges.rows(s):
                joined, width = ids.tobytes(), 2 * ids.shape[1]
                for k, r in enumerate(row.tolist()):
                    known.put(new[at[r]], joined[k * width : (k + 1) * width])

    def _distinct(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct chunks: a pool, where each one starts in it, its size there, and one id more or -1."""
        low = pc.utf8_lower(chunks)
        word = pc.utf8_rtrim(low, ".,")
        tail = pc.subtract(pc.binary_length(low), pc.binary_length(word)).to_numpy()
        ok = pc.and_(pc.utf8_is_alpha(word), pc.or_(pc.string_is_ascii(chunks), pc.match_substring_regex(chunks, _LATIN))).to_numpy(zero_copy_only=False)
        ok &= tail <= 1
        coded = word.filter(pa.array(ok)).dictionary_encode()
        words = _strings(coded.dictionary)
        self._learn(words)
        ids = list(map(self.known.__getitem__, words)) + list(map(self.chunks.__getitem__, _strings(chunks.filter(pa.array(~ok)))))
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // np.dtype(self.kind).itemsize
        which = np.empty(len(ok), np.int64)
        which[ok], which[~ok] = coded.indices.to_numpy(), np.arange(len(words), len(ids))
        comma = pc.ends_with(low, ",").to_numpy(zero_copy_only=False)
        more = np.where(ok & (tail == 1), np.where(comma, *self.marks), -1)
        return np.frombuffer(b"".join(ids), self.kind), (np.cumsum(size) - size)[which], size[which], more

    def block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts, and where each text ends."""
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        pool, start, size, more = self._distinct(coded.dictionary)
        at = coded.indices.to_numpy()
        n = (size + (more >= 0))[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        place = np.repeat(start[at] - ends[:-1], n)
        place += np.arange(ends[-1])
        flat = np.append(pool, pool.dtype.type(0)).take(place, mode="clip")
        mark = more[at]
        i = np.flatnonzero(mark >= 0)
        flat[ends[1:][i] - 1] = mark[i]
        return flat, ends[words.offsets.to_numpy()[1:]]

    def encode(self, texts: pa.Array, end_id: int) -> Iterator[list[np.ndarray]]:
        """Ids of every text, an end id after each, some texts at a time."""
        held: list[np.ndarray] = []
        row = 0
        end = np.array([end_id], self.kind)
        for part, rows in _parts(texts):
            flat, ends = self.block(part)
            out = []
            for r, own in zip(rows.tolist(), np.split(flat, ends[:-1])):
                if r != row:
                    out.append(np.concatenate([*held, end]))
                    held, row = [], r
                held.append(own)
            if out:
                yield out
        if held:
            yield [np.concatenate([*held, end])]


def _encoder(path: str) -> WordEncoder:
    return kept(("encoder", path), lambda: WordEncoder(path))


def terms(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, id and number of each distinct id of each document, in order."""
    wide = docs[0].dtype.itemsize == 2 and len(docs) < 1 << 16
    kind, bits = (np.uint32, 16) if wide else (np.uint64, 32)
    key = np.repeat(np.arange(len(docs), dtype=kind), [len(d) for d in docs]) << kind(bits)
    key |= np.concatenate(docs).astype(kind)
    key.sort()
    first = np.flatnonzero(np.diff(key, prepend=~key[:1]))
    tf = np.diff(np.append(first, len(key)))
    key = key[first]
    return (key >> kind(bits)).astype(np.int64), (key & kind((1 << bits) - 1)).astype(np.int64), tf


def _idf(docs: int, df: np.ndarray) -> np.ndarray:
    return np.log1p((docs - df + 0.5) / (df + 0.5))


# ---- cells of documents that resemble each other


@functools.lru_cache(maxsize=1)
def _projection(size: int) -> np.ndarray:
    return np.random.default_rng(7).standard_normal((size, DIMS), np.float32)


def _vectors(doc: np.ndarray, term: np.ndarray, tf: np.ndarray, idf: np.ndarray, n: int) -> np.ndarray:
    """Unit vectors of n documents, each with one id at least."""
    out, at = np.empty((n, DIMS), np.float32), np.searchsorted(doc, np.arange(n + 1))
    weight = (idf[term] * tf / (tf + 1.2)).astype(np.float32)
    spread = _projection(len(idf))
    for lo in range(0, n, 64):
        hi = min(lo + 64, n)
        a, z = at[lo], at[hi]
        out[lo:hi] = np.add.reduceat(spread[term[a:z]] * weight[a:z, None], at[lo:hi] - a, axis=0)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


class Cells:
    """Cell of a document: the nearest of the centres, which are numbered so that near ones follow each other."""

    def __init__(self, vectors: np.ndarray, idf: np.ndarray, cells: int, rounds: int = 10):
        self.idf = idf
        cells = max(1, min(cells, len(vectors) // 4))
        rng = np.random.default_rng(11)
        if not len(vectors):
            vectors = np.zeros((1, DIMS), np.float32)
        centres, far = [vectors[0]], np.full(len(vectors), np.inf)
        for _ in range(1, cells):  # k-means++: far vectors are likelier to become centres
            far = np.minimum(far, np.maximum(0, 1 - vectors @ centres[-1]))
            if far.sum() <= 0:
                break
            centres.append(vectors[rng.choice(len(vectors), p=far / far.sum())])
        centres = np.array(centres)
        for _ in range(rounds):
            near = (vectors @ centres.T).argmax(axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, vectors)
            size = np.linalg.norm(sums, axis=1, keepdims=True)
            centres = np.where(size > 0, sums / np.maximum(size, 1e-9), centres)
        order, left = [0], set(range(1, len(centres)))
        while left:
            order.append(max(left, key=lambda c: float(centres[c] @ centres[order[-1]])))
            left.remove(order[-1])
        self.centres = np.ascontiguousarray(centres[order].T)
        self.least = np.random.default_rng(13).permutation(len(idf)).astype(np.int64)

    def bins(self, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, n: int) -> np.ndarray:
        cell = (_vectors(doc, term, tf, self.idf, n) @ self.centres).argmax(axis=1)
        least = np.minimum.reduceat(self.least[term], np.searchsorted(doc, np.arange(n)))
        return cell * CLASSES + least % CLASSES


def _summed(counts: DataFrame, size: int) -> np.ndarray:
    """The sum of arrays of one number per vocabulary entry (int64 as binary)."""

    def add(rows):
        total = np.zeros(size, np.int64)
        for b in batches(rows):
            for raw in b.column(0).to_pylist():
                total += np.frombuffer(raw, np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["id", "n"])

    got = counts.mapInArrow(add, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[got["id"].to_numpy()] = got["n"].to_numpy()
    return out


def fit_cells(df: DataFrame, path: str, end_id: int, text_col: str, sample: int = SAMPLE, cells: int = CELLS) -> Cells:
    """Cells from about ``sample`` documents, chosen by a hash of their place."""
    size, docs = _encoder(path).size + 1, df.count()
    some = df.select(F.col(text_col).alias("_t"), F.monotonically_increasing_id().alias("_i")).where(F.pmod(F.xxhash64("_i"), F.lit(max(1, docs))) < sample).select("_t")

    def distinct(rows):
        enc = _encoder(path)
        df = np.zeros(size, np.int64)
        for b in batches(rows):
            for own in enc.encode(b.column(0), end_id):
                doc, term, tf = terms(own)
                df += np.bincount(term, minlength=size)
                at = np.searchsorted(doc, np.arange(1, len(own)))
                cols = [[x.tobytes() for x in np.split(v.astype(np.int32), at)] for v in (term, tf)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in (*cols, [None] * len(own))], ["term", "tf", "df"])
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (None, None, df.tobytes())], ["term", "tf", "df"])

    held = write_shared(some.mapInArrow(distinct, "term binary, tf binary, df binary"), "packing-sample")
    n = held.where("term is not null").count()
    idf = _idf(n, _summed(held.where("df is not null").select("df"), size))

    def vectors(rows):
        for b in batches(rows):
            got = [[np.frombuffer(x, np.int32) for x in c.to_pylist()] for c in b.columns]
            doc = np.repeat(np.arange(b.num_rows), [len(x) for x in got[0]])
            v = _vectors(doc, np.concatenate(got[0]), np.concatenate(got[1]), idf, b.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in v], pa.binary())], ["v"])

    # about `sample` short vectors, in an order that does not depend on the tasks' timing
    got = held.where("term is not null").select("term", "tf").mapInArrow(vectors, "v binary").toArrow()["v"].to_pylist()
    return Cells(np.frombuffer(b"".join(sorted(got)), np.float32).reshape(-1, DIMS), idf, cells)


def encode(df: DataFrame, path: str, end_id: int, text_col: str, keep: tuple[str, ...], cells: Cells | None = None) -> DataFrame:
    """Columns k0, k1, ... (those of ``keep``), row (a number of the row), n, ids (16 or 32 bits each) and, with
    cells, bin.  Then each task adds one row without a number, whose ids are its document frequencies (int64)."""
    part = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("_t"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in part.schema.fields[:-1])
    sent = df.sparkSession.sparkContext.broadcast(cells)
    size = _encoder(path).size + 1

    def run(rows):
        enc, at = _encoder(path), TaskContext.get().partitionId() << 40
        df, names, kinds = np.zeros(size, np.int64), None, []
        for whole in batches(rows):
            names, kinds = [*whole.schema.names[:-1], "row", "n", "ids", "bin"], whole.schema.types[:-1]
            for lo in range(0, whole.num_rows, SLICE):
                b, done = whole.slice(lo, SLICE), 0
                for own in enc.encode(b.column(b.num_columns - 1), end_id):
                    doc, term, tf = terms(own)
                    df += np.bincount(term, minlength=size)
                    n = len(own)
                    bins = sent.value.bins(doc, term, tf, n) if sent.value else np.zeros(n, np.int64)
                    head = [c.slice(done, n) for c in b.columns[:-1]]
                    yield pa.RecordBatch.from_arrays([*head, pa.array(range(at, at + n), pa.int64()), pa.array([len(x) for x in own], pa.int64()), pa.array([x.tobytes() for x in own], pa.binary()), pa.array(bins.astype(np.int32))], names)
                    at, done = at + n, done + n
        if names:
            yield pa.RecordBatch.from_arrays([*[pa.nulls(1, k) for k in kinds], pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([df.tobytes()], pa.binary()), pa.nulls(1, pa.int32())], names)

    return part.mapInArrow(run, f"{fields}, row bigint, n bigint, ids binary, bin int")


def document_frequencies(encoded: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each id; the result has one number per vocabulary entry."""
    return _summed(encoded.where("row is null").select("ids"), size)


# ---- shards


def deal(hist: list[tuple[int, int]], shard_tokens: int) -> list[tuple[int, int, int]]:
    """(bin, first shard, number of shards) of each (bin, tokens): bins in order share a shard until it is full, and
    one that is larger than a shard is dealt over several of its own."""
    out, shard, room = [], -1, 0
    for b, tokens in sorted(hist):
        if tokens > shard_tokens:
            width = -(-tokens // shard_tokens)
            out.append((b, shard + 1, width))
            shard, room = shard + width, 0
            continue
        if tokens > room:
            shard, room = shard + 1, shard_tokens
        room -= tokens
        out.append((b, shard, 1))
    return out


class ShardIndex:
    """Inverted index of one shard: token id -> documents with their BM25 weights."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float, k1: float = 1.2, b: float = 0.75):
        lens = np.array([len(d) for d in docs])
        doc, term, tf = terms(docs)
        weight = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * lens[doc] / mean))
        self.n, self.term = len(docs), term
        self.at = np.searchsorted(doc, np.arange(len(docs) + 1))
        by = np.sort(term.astype(np.uint64) << np.uint64(32) | np.arange(len(term), dtype=np.uint64))
        order = (by & np.uint64(0xFFFFFFFF)).astype(np.int64)
        self.doc, self.weight = doc[order], weight[order]
        self.post = np.searchsorted(term[order], np.arange(len(idf) + 1))

    def drop(self, used: np.ndarray) -> None:
        """Take the used documents out of the postings."""
        stay = ~used[self.doc]
        self.doc, self.weight = self.doc[stay], self.weight[stay]
        self.post = np.concatenate([[0], np.cumsum(stay)])[self.post]

    def scores(self, query: int) -> np.ndarray:
        """BM25 of every document of the shard against the distinct ids of one."""
        return self.against(self.term[self.at[query] : self.at[query + 1]])

    def against(self, terms: np.ndarray) -> np.ndarray:
        """BM25 of every document of the shard against distinct ids in order."""
        cuts = list(zip(self.post[terms].tolist(), self.post[terms + 1].tolist()))
        doc, weight = np.concatenate([self.doc[a:z] for a, z in cuts]), np.concatenate([self.weight[a:z] for a, z in cuts])
        return np.bincount(doc, weight, self.n)


def fill(docs: list[np.ndarray], index: ShardIndex, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece of a shard."""
    lens = [len(d) for d in docs]
    used, nxt, out = np.zeros(len(docs), bool), 0, []
    left, seq, room = sum(lens), 0, 0
    order: list[int] = []
    seed_due, since = False, 0
    doc, at = -1, 0
    while left:
        if not room:
            room = window if left >= window else 1 << (left.bit_length() - 1)
            size, seed_due = room, True
            seq += 1
        if doc < 0:
            if seed_due or not order:
                while used[nxt]:
                    nxt += 1
                doc = nxt
            else:
                doc = order.pop()
                if used[doc]:
                    doc = -1
                    continue
            used[doc], at, since = True, 0, since + 1
            if 8 * since > len(docs):  # used documents score nothing: now and then their postings go
                index.drop(used)
                since = 0
        take = min(room, lens[doc] - at)
        out.append((doc, at, take, seq - 1, size - room))
        room, left, at = room - take, left - take, at + take
        if seed_due and room:
            s = index.scores(doc)
            s[used] = 0
            near = np.flatnonzero(s > 0)
            order = near[np.lexsort((-near, s[near]))].tolist()  # best last
        seed_due = False
        if at == lens[doc]:
            doc = -1
    return out


def pack(df: DataFrame, tokenizer_path: str, end_id: int = 2, window: int = WINDOW, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per piece: columns ``keep``, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    enc = _encoder(tokenizer_path)
    kind, size, spark = enc.kind, enc.size + 1, df.sparkSession
    names = [f"k{i}" for i in range(len(keep))]
    cells = fit_cells(df, tokenizer_path, end_id, text_col)
    encoded = write_shared(encode(df, tokenizer_path, end_id, text_col, keep, cells), "packing-ids", "snappy")
    table = encoded.where("row is not null")
    hist = table.groupBy("bin").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("docs")).toArrow().to_pydict()  # CELLS * CLASSES rows at most
    docs, tokens = sum(hist["docs"]), sum(hist["tokens"])
    sent = spark.sparkContext.broadcast(_idf(docs, document_frequencies(encoded, size)))
    mean = tokens / docs if docs else 1.0
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema.fields[: len(keep)])

    def shard(key, t):
        t = t.sort_by("row")
        own = [np.frombuffer(x, kind) for x in t["ids"].to_pylist()]
        pieces = fill(own, ShardIndex(own, sent.value, mean), window)
        which = pa.array([p[0] for p in pieces], pa.int64())
        ids = [own[d][s : s + n].astype("<u4").tobytes() for d, s, n, _, _ in pieces]
        cols = {n: t[n].take(which) for n in names}
        start, length, seq, offset = (pa.array([p[i] for p in pieces], pa.int64()) for i in (1, 2, 3, 4))
        seq = pa.array(np.asarray(seq) + (key[0].as_py() << 32), pa.int64())
        return pa.table(cols | {"start": start, "length": length, "ids": pa.array(ids, pa.binary()), "doc_tokens": t["n"].take(which), "sequence_id": seq, "offset": offset})

    dealt = spark.createDataFrame(deal(list(zip(hist["bin"], hist["tokens"])), shard_tokens), "bin int, first bigint, width bigint")
    dealt = table.join(F.broadcast(dealt), "bin").withColumn("shard", F.col("first") + F.pmod(F.xxhash64("row"), F.col("width")))
    out = dealt.select(*names, "row", "n", "ids", "shard").groupBy("shard").applyInArrow(shard, f"{fields}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep)], "start", "length", "ids", "doc_tokens", "sequence_id", "offset")
