"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterable, Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Word separators of the byte-level word rule [^\x20\x09-\x0D]+ are exactly the
# bytes that bytes.split() without arguments splits on.
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(text: str | None) -> bytes:
    """UTF-8 bytes of a text; null is empty and a lone surrogate keeps its three bytes."""
    if not text:
        return b""
    try:
        return text.encode()
    except UnicodeEncodeError:
        return text.encode("utf-8", "surrogatepass")


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser: a bijection of 64-bit values."""
    x = x + GOLDEN
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


#: Folders of this process in the shared one, and the list that takes those of the work at hand.
_WRITTEN: list[str] = []
_SCOPE: ContextVar[list[str] | None] = ContextVar("scope", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is the session's ``spark.checkpoint.dir``.  Only where that is unset and all runs in one local process
    (tests, a laptop) a temporary folder takes its place, and is removed when the driver's Python ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="quire-shared-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def shared_path(spark: SparkSession, label: str) -> str:
    """A new name in the shared folder."""
    path = f"{shared_dir(spark)}/quire-{label}-{uuid.uuid4().hex}"
    for held in (_WRITTEN, _SCOPE.get()):
        if held is not None:
            held.append(path)
    return path


@contextlib.contextmanager
def scope() -> Iterator[list[str]]:
    """The list of the shared folders that are named inside, by this thread."""
    token = _SCOPE.set(held := [])
    try:
        yield held
    finally:
        _SCOPE.reset(token)


def read_by(df: DataFrame, paths: Iterable[str]) -> list[str]:
    """Those of the shared folders that a table, which may not be computed yet, reads."""
    names = {part for f in df.inputFiles() for part in f.split("/")}
    return [p for p in paths if p.rsplit("/", 1)[1] in names]


def write_shared(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write a table once in the shared folder and read it back: later steps survive lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: Iterable[str]) -> None:
    """Remove some of the shared folders that this process wrote."""
    for p in paths:
        if p in _WRITTEN:
            _WRITTEN.remove(p)
            path = spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Remove what this process wrote in the shared folder.  Results that were not written by then are lost."""
    discard(spark, list(_WRITTEN))


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, for small tables of iterative steps."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


_KEPT: dict[Hashable, object] = {}


def kept(key: Hashable, make: Callable[[], object]):
    """What a worker keeps from task to task.  Other operators use the worker next, so it goes when another key is asked for."""
    got = _KEPT.get(key)
    if got is None:
        _KEPT.clear()
        got = _KEPT[key] = make()
    return got


def columns_of(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def batches(rows: Iterator[pa.RecordBatch], size: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Batches that have rows, in slices of about ``size`` bytes.

    Workers are used again by later tasks, so at the end what was freed goes back to the system.
    """
    for b in rows:
        step = max(64, b.num_rows * size // max(1, b.nbytes))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)
    del rows
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
