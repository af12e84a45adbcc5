"""Files in: text in any encoding, rule tables, run logs, manifests, images."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from quire.functions import encoding as enc
from quire.operators.runs import numbered

RULES = "enable boolean, id bigint, name string, rule string, serialNumber int, example string"
RUN_LOG = (
    "run_id string, ts_start string, scene string, version string, mode string, sample string, sample_id string, repeat_idx int, warmup boolean, ok boolean, error string, "
    "env_baseline struct<cpu_pct:double,mem_free_gb:double>, wall_s double, decode_s double, parse_s double, detect_s double, chapter_count int, first_titles array<string>, "
    "output_size bigint, epub_valid boolean, epub_path string, per_book map<string,struct<chapter_count:int,book_s:double>>, batch_n int, sample_ids array<string>, "
    "peak_rss_mb double, exe_proc_count int, exe_peak_rss_mb double, ts_end string, seq int, runner_wall_s double"
)
MANIFEST = "id string, file string, orig_name string, size_bytes bigint, size_mb double, encoding string, md5 string, source string"
IMAGES = (".jpg", ".jpeg", ".png", ".bmp", ".gif", ".webp")


def _existing(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Paths that exist, whatever store they are in."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    out = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).exists(path):
            out.append(p)
    return list(dict.fromkeys(out))


def scan_files(spark: SparkSession, roots: Sequence[str], exts: Sequence[str] = (".txt",), recursive: bool = True) -> DataFrame:
    """(path, modificationTime, length, content): files with one of the suffixes, in any case; missing roots are skipped."""
    here = _existing(spark, roots)
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    if not here:
        return spark.createDataFrame([], schema)
    got = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(here)
    # the source gives no row for a file of length 0: those are the listed paths that it does not read
    names = [unquote(p) for p in got.inputFiles()]
    listed = spark.createDataFrame([(p.replace("file:///", "file:/", 1),) for p in names], "path string")
    empty = listed.join(got.select("path"), "path", "left_anti").select("path", F.lit(None).cast("timestamp").alias("modificationTime"), F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content"))
    got = got.unionByName(empty)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./\\]*)$", 1))
    return got.where(suffix.isin(*[e.lower() for e in exts])).dropDuplicates(["path"])


def detect(files: DataFrame, limit: int = enc.STAGES[-1]) -> DataFrame:
    """Files with book_id, encoding and confidence; an encoding that is given by column ``declared`` wins."""
    found = files.withColumn("_d", enc.detect(F.col("content"), limit=limit))
    name = F.coalesce(F.col("declared"), F.col("_d.encoding")) if "declared" in files.columns else F.col("_d.encoding")
    return found.select(F.xxhash64("path").alias("book_id"), *files.columns, name.alias("encoding"), F.col("_d.confidence").alias("confidence")).drop("declared")


def file_lines(files: DataFrame, block: int = 1 << 20) -> DataFrame:
    """(book_id, line_no, line, ended) of files with an encoding; bytes that do not decode are dropped.

    Universal newlines.  A file is decoded in blocks, so a task holds its bytes and one block of text.
    """

    def run(rows):
        import codecs

        for b in rows:
            for book, raw, name in zip(*(b.column(i).to_pylist() for i in range(3))):
                try:
                    decoder = codecs.getincrementaldecoder(name or "utf-8")(errors="ignore")
                except LookupError:  # such a file has no lines; unreadable() tells of it
                    continue
                rest, no = "", 0
                for at in range(0, max(1, len(raw or b"")), block):
                    part = (raw or b"")[at : at + block]
                    last = at + block >= len(raw or b"")
                    text = rest + decoder.decode(part, last)
                    held = ""
                    if not last and text.endswith("\r"):
                        text, held = text[:-1], "\r"
                    found = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
                    rest = found.pop() + held
                    ended = [True] * len(found)
                    if last and rest:
                        found.append(rest)
                        ended.append(False)
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array([book] * len(found), pa.int64()), pa.array(range(no, no + len(found)), pa.int64()), pa.array(found, pa.string()), pa.array(ended, pa.bool_())], ["book_id", "line_no", "line", "ended"])
                        no += len(found)

    return files.select("book_id", "content", "encoding").mapInArrow(run, "book_id bigint, line_no bigint, line string, ended boolean")


def unreadable(books: DataFrame) -> DataFrame:
    """(book_id, error) of files whose encoding is none that there is."""
    return books.where(~enc.is_codec(F.coalesce("encoding", F.lit("utf-8")))).select("book_id", F.concat(F.lit("unknown encoding: "), F.col("encoding")).alias("error"))


def split_file_lines(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """(book_id, path, line_no, line, ended) of text files of any size: a file is read in blocks by many tasks.

    Lines are found as bytes (ends \\n, \\r\\n, \\r), so the encoding must hold no such byte inside a character, as is so for
    UTF-8, GB18030, Big5 and all single-byte ones, not for UTF-16.  Lines are numbered within each block, after those
    of the blocks before; only the blocks' counts come together.  ``ended`` is true of all lines (whether the last one
    has an end is not seen by a reader of blocks).
    """
    if encoding.lower().replace("_", "-").startswith(("utf-16", "utf-32")):
        raise ValueError("lines of UTF-16 and UTF-32 cannot be found as bytes: use file_lines")
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"), F.col("value").cast("binary").alias("raw"))
    counts = rows.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("path", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("at"))
    inside = F.row_number().over(Window.partitionBy("path", "block").orderBy("i")) - 1
    got = rows.withColumn("k", inside).join(offsets, ["path", "block"])
    line = enc.decode(F.col("raw"), F.lit(encoding)) if encoding.lower() not in ("utf-8", "utf8") else F.make_valid_utf8(F.col("raw").cast("string"))
    return got.select(F.xxhash64("path").alias("book_id"), "path", (F.col("at") + F.col("k")).alias("line_no"), line.alias("line"), F.lit(True).alias("ended"))


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """UTF-8 text without Python: one row per line, splittable; for counts and filters that need no order."""
    return spark.read.text(path).select(F.col("value").alias("line"), F.input_file_name().alias("path"))


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """The rule table with ``pos``, the place in the file."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"array<struct<{', '.join(x.replace(' ', ':', 1) for x in RULES.split(', '))}>>").alias("r"))
    return whole.select(F.posexplode("r").alias("pos", "r")).select("pos", "r.*")


def read_run_log(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """JSON lines with a fixed schema; blank and malformed lines and missing files give nothing."""
    here = _existing(spark, paths)
    if not here:
        return spark.createDataFrame([], T._parse_datatype_string(RUN_LOG))
    return spark.read.schema(RUN_LOG).option("mode", "DROPMALFORMED").json(here)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("multiLine", True).json(path)


def ingest(files: DataFrame) -> DataFrame:
    """A manifest of scanned files: id by size, MD5, the first encoding that decodes all of it.  The same files give the same manifest."""
    name = F.regexp_extract("path", r"([^/\\]*)$", 1)
    got = files.select(name.alias("orig_name"), F.col("length").alias("size_bytes"), F.round(F.col("length") / 1048576, 2).alias("size_mb"), enc.strict_ladder(F.col("content")).alias("encoding"), F.md5("content").alias("md5"), F.col("path").alias("source"), "length", "path")
    got = numbered(got, "length", [F.col("length"), F.col("path")], "n")
    return got.withColumn("id", F.format_string("%02d", F.col("n"))).withColumn("file", F.concat("id", F.lit(".txt"))).select("id", "file", "orig_name", "size_bytes", "size_mb", "encoding", "md5", "source")


def read_images(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    return scan_files(spark, roots, IMAGES)
