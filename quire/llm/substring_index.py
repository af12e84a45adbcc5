"""The log-structured fingerprint index: sorted immutable runs, merge-joined with each new batch, then compacted.

Indexed are the window hashes of ``substring``: for each window of ``width`` words the least hash of its word
grams (equal windows have equal ones), once per chunk of documents.  On disk, all in ``path``:

- ``state-N``: the manifest, a small JSON file: window width, gram, buckets, live runs, batches.  The highest
  one counts.  It is written last, so a lost job leaves the index as it was, and files no manifest names are dead.
- ``run-*``: Parquet (k, chunk, many), in ``buckets`` buckets by k, each sorted by k; never changed.
- ``chunks-*``: the documents of a batch, packed, which later batches are verified against.
- ``again-*``: (chunk, k) of every entry, new or old, whose hash a batch found again.

A batch brings one run.  Runs have the same buckets, so bucket meets bucket in a merge join: no run is
shuffled again, and a hash in many chunks is one entry in each, never a pair of them.  More than ``fanout``
runs are merged into one (``compact``), with more buckets once they hold over ``PER_BUCKET`` entries.

``append`` takes a batch by its name.  A batch that the manifest has is not added again: it is answered as it
was the first time.  What was handed out for earlier batches stays as it is; ``found`` of all batches together
judges all documents alike, whatever the batches were, which is what ``substring.remove_repeats`` does.

Defined results are those of ``substring``; an index without runs matches a batch with itself; an empty batch
is an empty run; another width or gram than the index has is refused.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quire.llm import substring as sub

_ENTRY = "k BIGINT, chunk BIGINT, many BOOLEAN"
_AGAIN = "chunk bigint, k bigint"
#: Entries of a bucket beyond which compaction doubles the buckets.
PER_BUCKET = 50_000_000
#: Bits of a chunk's number below that of its batch.
BATCH_BITS = 48


class Index:
    def __init__(self, spark: SparkSession, path: str, width: int = sub.WIDTH, gram: int = sub.GRAM, fanout: int = 2):
        self.spark, self.path, self.fanout = spark, path.rstrip("/"), fanout
        jvm = spark._jvm
        self._file = jvm.org.apache.hadoop.fs.Path
        self._fs = self._file(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.number, self.state = self._newest()
        if self.state is None:
            self.state = {"width": width, "gram": gram, "buckets": int(spark.conf.get("spark.sql.shuffle.partitions")), "runs": [], "batches": {}}
        if (self.state["width"], self.state["gram"]) != (width, gram):
            raise ValueError(f"the index has windows of {self.state['width']} words and grams of {self.state['gram']}")

    # ---- the manifest

    def _newest(self) -> tuple[int, dict | None]:
        root = self._file(self.path)
        names = [s.getPath().getName() for s in self._fs.listStatus(root)] if self._fs.exists(root) else []
        numbers = [int(n.split("-")[1]) for n in names if n.startswith("state-")]
        if not numbers:
            return 0, None
        at = self._file(f"{self.path}/state-{max(numbers):06d}")
        source = self._fs.open(at)
        try:
            raw = bytes(source.readNBytes(int(self._fs.getFileStatus(at).getLen())))
        finally:
            source.close()
        return max(numbers), json.loads(raw)

    def _commit(self) -> None:
        """Write the next manifest; rename makes it appear whole, and fails if another writer was first."""
        self.number += 1
        half, whole = self._file(f"{self.path}/.state-{uuid.uuid4().hex}"), self._file(f"{self.path}/state-{self.number:06d}")
        out = self._fs.create(half, False)
        out.write(bytearray(json.dumps(self.state).encode()))
        out.close()
        if self._fs.exists(whole) or not self._fs.rename(half, whole):
            raise RuntimeError("another writer has changed the index")

    # ---- runs

    def _write_run(self, entries: DataFrame, buckets: int) -> dict:
        run = {"name": f"run-{uuid.uuid4().hex}", "buckets": buckets}
        name = "quire_" + run["name"].replace("-", "_")
        entries.repartition(buckets, "k").write.bucketBy(buckets, "k").sortBy("k").option("path", f"{self.path}/{run['name']}").option("compression", "lz4").format("parquet").saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")  # the files stay
        return run

    def _run(self, run: dict) -> DataFrame:
        """A run as a bucketed table.  The table is only a name in this session: a plan keeps what it needs of it."""
        name = "quire_" + run["name"].replace("-", "_")
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({_ENTRY}) USING parquet CLUSTERED BY (k) SORTED BY (k) INTO {run['buckets']} BUCKETS LOCATION '{self.path}/{run['name']}'")
        return self.spark.table(name)

    def runs(self) -> list[DataFrame]:
        """The live runs, oldest first."""
        return [self._run(r) for r in self.state["runs"]]

    def close(self) -> None:
        """Forget the tables' names; the files stay."""
        for t in self.spark.catalog.listTables():
            if t.name.startswith("quire_run_"):
                self.spark.sql(f"DROP TABLE IF EXISTS {t.name}")

    def compact(self) -> None:
        """Merge all runs into one; those it stands for are no longer read."""
        if len(self.state["runs"]) < 2:
            return
        runs, buckets = self.runs(), self.state["buckets"]
        every = runs[0]
        for r in runs[1:]:
            every = every.union(r)
        if every.count() > PER_BUCKET * buckets:
            buckets *= 2
        self.state |= {"buckets": buckets, "runs": [self._write_run(every, buckets)]}
        self._commit()

    # ---- batches

    def load(self, df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
        """The chunks of some documents."""
        return sub.chunks_of(df, text_col, keep, self.state["width"], self.state["gram"])

    def add(self, chunks: DataFrame, batch: str) -> None:
        """Add the run of a batch of chunks and what it found again.  Chunks have numbers of their own in the index."""
        if batch in self.state["batches"]:
            return
        if len(self.state["runs"]) >= self.fanout:
            self.compact()
        run = self._write_run(sub.entries(chunks), self.state["buckets"])
        new = self._run(run)
        counted = new.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("k")))
        again = counted.where("n > 1 or many").select("chunk", "k")
        for old in self.runs():
            again = again.union(new.join(old, "k", "left_semi").select("chunk", "k")).union(old.join(new, "k", "left_semi").select("chunk", "k"))
        name = f"again-{uuid.uuid4().hex}"
        again.write.option("compression", "lz4").parquet(f"{self.path}/{name}")
        self.state["runs"].append(run)
        self.state["batches"][batch] = {"again": name, "number": len(self.state["batches"])}
        self._commit()

    def found(self, batches: list[str] | None = None) -> DataFrame:
        """(chunk, k): what the batches, or all, found again; may repeat itself."""
        names = [v["again"] for k, v in self.state["batches"].items() if batches is None or k in batches]
        return self.spark.read.schema(_AGAIN).parquet(*[f"{self.path}/{n}" for n in names]) if names else self.spark.createDataFrame([], _AGAIN)

    def append(self, df: DataFrame, batch: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), digest: bool = False) -> DataFrame:
        """Match a batch with itself and all before it, add it, and return keep, n_words, n_removed, kept for its documents."""
        kinds = [f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields]
        known = self.state["batches"].get(batch)
        if known is None:
            number, place = len(self.state["batches"]), f"{self.path}/chunks-{uuid.uuid4().hex}"
            self.load(df, text_col, keep).withColumn("chunk", F.col("chunk") + (number << BATCH_BITS)).write.option("compression", "lz4").parquet(place)
            self.add(self.spark.read.schema(sub.CHUNK).parquet(place), batch)
            self.state["batches"][batch]["chunks"] = place.rsplit("/", 1)[1]
            self._commit()
            known = self.state["batches"][batch]
        wanted = self.found([batch])
        folders = {k: v["chunks"] for k, v in self.state["batches"].items() if v["number"] <= known["number"]}
        mine = self.spark.read.schema(sub.CHUNK).parquet(f"{self.path}/{known['chunks']}")
        before = [f"{self.path}/{f}" for k, f in folders.items() if k != batch]
        old = self.spark.read.schema(sub.CHUNK).parquet(*before).join(wanted, "chunk", "left_semi") if before else None
        return sub.remove(mine, wanted, kinds, self.state["width"], self.state["gram"], digest, old)
