"""A folder of texts as a stream: each micro-batch runs the batch plan, the checkpoint is what resumes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quire.operators.segment import segment

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def watch_documents(spark: SparkSession, folder: str, out: str, checkpoint: str, pattern: str | None = None, once: bool = True) -> StreamingQuery:
    """Chapters of every document file that arrives, written under ``out`` by batch number.

    A batch that is run again after a failure overwrites its own folder, so chapters are written once.
    """

    def batch(docs: DataFrame, number: int) -> None:
        segment(docs, pattern=pattern).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(DOCUMENTS).parquet(folder)
    q = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (q.trigger(availableNow=True) if once else q).start()
