"""WARC archives: write captures, read records back, assemble transactions.

Writing: each input row becomes a request, a response (or revisit) and a metadata record; request and metadata
have the capture's id as WARC-Concurrent-To.  Every record is a gzip member of its own.  Records go out through
Spark's text writer in segments of about ``segment_bytes``, one a file, so archives land wherever Spark can write
and no file is much longer than that or than one record.

Of rows with equal payloads of at least ``min_bytes`` bytes the one with the smallest id is written as a
response; the others revisit it (profile identical-payload-digest) and carry no payload.

Reading: archives of any writer, plain or gzip in any number of members, are inflated piece by piece and parsed by
Content-Length; every archive is read once.  Transaction assembly brings request and metadata records to the
response or revisit they are concurrent to (or that names them, in the same file), one nested row per capture.

Defined results, writing: a null payload is empty; rows that repeat an id are captures of their own, and if that id
is the smallest all of them are responses; a null id is never the smallest, and a payload that only rows
without id have makes them all responses; a null URL is written as an empty one; long payloads are written whole;
an empty table gives no row.
Reading: a header that is missing is null (no HTTP Content-Length: a response's payload is what follows its
header, a revisit's size is null); a repeated header's values are joined by newlines, repeated WARC-Concurrent-To
are all followed; a digest other than SHA-1 is not checked (payload_ok is null); where a file is cut short or is no
WARC, the records before that stand and a last row says so in ``error``; an empty file has no record.  A capture
without request or metadata record still gives a row (null structs), of several the one of smallest record id
counts; requests and metadata of no capture give none.  Columns not named are left out.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.llm.common import batches, columns_of, shared_path, utf8

END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Copies of each key of the join that tells copies of a payload its first page: a hot one meets as many tasks.
SALTS = 16
_FIELDS = (
    "record_id string, type string, concurrent_to array<string>, target_uri string, date string, page_id bigint, refers_to bigint, refers_to_id string, refers_to_uri string, "
    "payload_bytes bigint, payload_digest string, payload_ok boolean, block_bytes bigint, fields map<string,string>, payload binary, error string"
)
_NAMES = [x.split()[0] for x in _FIELDS.replace("map<string,string>", "map").split(", ")]
_MAIN = ("response", "revisit")


def base32_sha1(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def _gzip(raw: bytes, level: int = 1) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


#: What ends a record, as a gzip member.
_END = _gzip(END.encode())


# ---- writing


def _record(kind: str, rid: str, date: str, block: bytes, more: dict[str, object]) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{rid}>", "WARC-Date": date, **more, "Content-Length": len(block)}
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in head.items() if v is not None), "\r\n"]).encode("utf-8", "surrogatepass") + block


def plan_revisits(df: DataFrame, payload_col: str = "html", id_col: str = "page_id", url_col: str = "url", min_bytes: int = 0) -> DataFrame:
    """(id, url, payload, first, first_url, revisit): first is the smallest id with the same payload, or null for a response."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("sum", F.concat(F.sha1("payload"), F.lit(" "), F.octet_length("payload").cast("string")))
    first = rows.groupBy("sum").agg(F.min("id").alias("least"), F.min_by("url", "id").alias("least_url"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = first.select("sum", "least", "least_url", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    got = rows.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int")).join(first, ["sum", "salt"], "left")
    other = (F.octet_length("payload") >= min_bytes) & F.col("least").isNotNull() & ~F.col("id").eqNullSafe(F.col("least"))
    return got.select("id", "url", "payload", F.when(other, F.col("least")).alias("first"), F.when(other, F.col("least_url")).alias("first_url"), other.alias("revisit"))


def write_archives(df: DataFrame, path: str, payload_col: str = "html", id_col: str = "page_id", url_col: str = "url", min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", segment_bytes: int = 32_000_000) -> None:
    def clean(url: str | None) -> str:
        return (url or "").replace("\r", "%0D").replace("\n", "%0A")

    def build(rows):
        at, mark, out, size = 0, TaskContext.get().partitionId(), [], 0
        for b in batches(rows):
            for page, url, payload, first, first_url, revisit in zip(*columns_of(b, "id", "url", "payload", "first", "first_url", "revisit")):
                raw, at = utf8(payload), at + 1
                rid, req, meta = (uuid.uuid5(uuid.NAMESPACE_URL, f"{kind} {page} {mark} {at}") for kind in ("capture", "request", "metadata"))
                url = clean(url)
                host, _, rest = url.partition("://")[2].partition("/")
                common = {"WARC-Target-URI": url, "WARC-Page-ID": page}
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(raw)}{END}".encode()
                sum_ = f"sha1:{base32_sha1(raw)}"
                more = {"WARC-Profile": PROFILE, "WARC-Refers-To-Target-URI": clean(first_url), "WARC-Refers-To-Date": date, "WARC-Refers-To-Page-ID": first} if revisit else {}
                records = (
                    _record("request", req, date, f"GET /{rest} HTTP/1.1\r\nHost: {host}{END}".encode("utf-8", "surrogatepass"), common | {"WARC-Concurrent-To": f"<urn:uuid:{rid}>", "Content-Type": "application/http;msgtype=request"}),
                    _record("revisit" if revisit else "response", rid, date, http if revisit else http + raw, common | more | {"WARC-Payload-Digest": sum_, "Content-Type": "application/http;msgtype=response"}),
                    _record("metadata", meta, date, f"payloadLength: {len(raw)}\r\n".encode(), common | {"WARC-Concurrent-To": f"<urn:uuid:{rid}>", "Content-Type": "application/warc-fields"}),
                )
                for r in records:
                    out.append(_gzip(r + END.encode()))
                    size += len(out[-1])
                if size >= segment_bytes:
                    yield segment(out)
                    out, size = [], 0
        if out:
            yield segment(out)

    def segment(members: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary())], ["record"])

    segments = plan_revisits(df, payload_col, id_col, url_col, min_bytes).mapInArrow(build, "record binary")
    # A string column is written byte by byte.  After each comes the separator, a member of line ends: a reader
    # takes line ends between records as they come.
    text = segments.select(F.col("record").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", _END.decode("latin-1"))
    text.option("maxRecordsPerFile", 1).text(path)


# ---- reading


class _Stream:
    """The bytes of an archive, inflated on demand."""

    def __init__(self, content: bytes):
        self.pieces, self.buf, self.at = self._inflated(content), bytearray(), 0

    @staticmethod
    def _inflated(content: bytes, step: int = 1 << 16) -> Iterator[bytes]:
        if content[:2] != b"\x1f\x8b":
            yield content
            return
        view, z = memoryview(content), None
        for lo in range(0, len(content), step):
            piece = bytes(view[lo : lo + step])
            while piece:
                if z is None:
                    piece = piece.lstrip(b"\0")  # padding between members
                    if not piece:
                        break
                    z = zlib.decompressobj(31)
                out = z.decompress(piece, 1 << 20)
                yield out
                piece = z.unused_data if z.eof else z.unconsumed_tail
                if z.eof:
                    z = None
        if z is not None:
            raise EOFError("the last gzip member is cut short")

    def _more(self) -> bool:
        for piece in self.pieces:
            if piece:
                if self.at > 1 << 20:
                    del self.buf[: self.at]
                    self.at = 0
                self.buf += piece
                return True
        return False

    def take(self, n: int) -> bytes:
        """The next n bytes, or what is left."""
        while len(self.buf) - self.at < n and self._more():
            pass
        got = bytes(self.buf[self.at : self.at + n])
        self.at += len(got)
        return got

    def head(self, most: int = 1 << 24) -> bytes | None:
        """A record's header, without the empty line; None at the end of the archive."""
        while True:  # line ends before it
            while self.at < len(self.buf) and self.buf[self.at] in b"\r\n":
                self.at += 1
            if self.at < len(self.buf):
                break
            if not self._more():
                return None
        look = 0
        while True:
            stop = self.buf.find(b"\r\n\r\n", self.at + max(0, look - 3))
            if stop >= 0:
                break
            look = len(self.buf) - self.at
            if look > most or not self._more():
                raise EOFError("a record's header has no end")
        got = bytes(self.buf[self.at : stop])
        self.at = stop + 4
        return got


def _text(raw: bytes) -> str:
    try:
        return raw.decode("utf-8", "surrogatepass")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def _headers(lines: list[str]) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in " \t" and out:  # folded
            out[-1] = out[-1][0], f"{out[-1][1]} {line.strip()}"
        elif ":" in line:
            name, value = line.split(":", 1)
            out.append((name.strip(), value.strip()))
    return out


def parse(raw: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """(headers, block) of every record of an archive; EOFError, ValueError or zlib.error where it goes wrong."""
    stream = _Stream(raw)
    while (head := stream.head()) is not None:
        lines = _text(head).split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC record where one should begin")
        fields = _headers(lines[1:])
        size = next((v for k, v in fields if k.lower() == "content-length"), "")
        if not size.isdecimal():
            raise ValueError("a record has no Content-Length")
        block = stream.take(int(size))
        if len(block) < int(size):
            raise EOFError("the last record is cut short")
        yield fields, block


def _number(v: str | None) -> int | None:
    return int(v) if v and v.isascii() and v.lstrip("-").isdecimal() and len(v) < 19 else None


def _row(fields: list[tuple[str, str]], block: bytes, payloads: bool) -> list:
    by: dict[str, list[str]] = {}
    for k, v in fields:
        by.setdefault(k.lower(), []).append(v)
    one = {k: v[0] for k, v in by.items()}
    shown: dict[str, str] = {}
    for k, v in fields:
        shown[k] = f"{shown[k]}\n{v}" if k in shown else v
    kind, body, size, ok = one.get("warc-type"), None, None, None
    digest = one.get("warc-payload-digest")
    if kind in _MAIN:
        http = one.get("content-type", "application/http").startswith("application/http")
        head, _, body = block.partition(b"\r\n\r\n") if http else (b"", b"", block)
        size = _number(dict((k.lower(), v) for k, v in _headers(_text(head).split("\r\n")[1:])).get("content-length"))
        if size is None and kind == "response":
            size = len(body)
        if digest and digest.lower().startswith("sha1:"):
            digest = digest[5:]
            ok = kind == "revisit" or (len(body) == size and base32_sha1(body) == digest)
    return [one.get("warc-record-id"), kind, by.get("warc-concurrent-to", []), one.get("warc-target-uri"), one.get("warc-date"), _number(one.get("warc-page-id")), _number(one.get("warc-refers-to-page-id")), one.get("warc-refers-to"), one.get("warc-refers-to-target-uri"), size, digest, ok, len(block), list(shown.items()), body if payloads and kind == "response" else None, None]


def _rows(out: list[list]) -> pa.RecordBatch:
    s, n = pa.string(), pa.int64()
    kinds = (s, s, pa.list_(s), s, s, n, n, s, s, n, s, pa.bool_(), n, pa.map_(s, s), pa.binary(), s)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], _NAMES)


def _archive(content: bytes, payloads: bool, bytes_at_once: int = 16_000_000) -> Iterator[pa.RecordBatch]:
    """The records of one file.  Requests and metadata that name no capture take the one that names them."""
    out, size, lone, named = [], 0, [], {}
    try:
        for fields, block in parse(content):
            r = _row(fields, block, payloads)
            if r[1] in _MAIN:
                named |= dict.fromkeys(r[2], r[0])
            if not r[2] and r[1] in ("request", "metadata"):
                lone.append(r)
                continue
            out.append(r)
            size += len(block)
            if len(out) == 3000 or size >= bytes_at_once:
                yield _rows(out)
                out, size = [], 0
    except (EOFError, ValueError, zlib.error) as e:
        out.append([None, None, [], *[None] * 10, [], None, f"{type(e).__name__}: {e}"])
    for r in lone:
        if r[0] in named:
            r[2] = [named[r[0]]]
    if out or lone:
        yield _rows(out + lone)


def read_archives(spark: SparkSession, path: str, payloads: bool = True, glob: str = "part-*") -> DataFrame:
    """One row per record, and one per file that goes wrong (``error``).  payload is that of responses, if asked for;
    payload_ok compares it with its digest."""

    def run(rows):
        for b in batches(rows):
            for i in range(b.num_rows):
                yield from _archive(b.column(0)[i].as_py() or b"", payloads)

    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("content").mapInArrow(run, _FIELDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: the response or revisit with its request and metadata structs.

    One shuffle: a capture's key is its own id, that of the others each id they are concurrent to."""
    is_main = F.col("type").isin(*_MAIN)
    part = F.struct("record_id", "date", "target_uri", "block_bytes", "fields")
    capture = F.struct("type", "date", "target_uri", "page_id", "refers_to", "refers_to_id", "refers_to_uri", "payload_bytes", "payload_digest", "payload_ok", "block_bytes", "fields", "payload")
    keyed = records.where(is_main | F.col("type").isin("request", "metadata")).select(
        F.explode(F.when(is_main, F.array("record_id")).otherwise(F.col("concurrent_to"))).alias("key"),
        F.when(is_main, F.struct("record_id", capture.alias("capture"))).alias("main"),
        *[F.when(F.col("type") == k, part).alias(k) for k in ("request", "metadata")],
    )
    # captures without an id cannot be named by others; a hash spreads them
    groups = keyed.groupBy(F.coalesce("key", F.concat(F.lit("no id "), F.xxhash64("main.capture.target_uri", "main.capture.date", "main.capture.payload_digest"))).alias("key")).agg(F.collect_list("main").alias("mains"), *[F.min_by(k, F.col(k)["record_id"]).alias(k) for k in ("request", "metadata")])
    return groups.select(F.explode("mains").alias("m"), "request", "metadata").select("m.record_id", "m.capture", "request", "metadata")


def captures(df: DataFrame, payload_col: str = "html", id_col: str = "page_id", url_col: str = "url", min_bytes: int = 0, payloads: bool = True, path: str | None = None) -> DataFrame:
    """Write the archives (to ``path``, else a new folder of the shared one), read them back, assemble."""
    spark = df.sparkSession
    path = path or shared_path(spark, "warc")
    write_archives(df, path, payload_col, id_col, url_col, min_bytes)
    return assemble(read_archives(spark, path, payloads))
