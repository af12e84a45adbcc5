"""The corpus pipeline: quality rules, language ID, SimHash near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as
the docs of the next.  All but the last return the columns of documents.

Every stage judges rows, not ids: a document's columns go with it through each stage.

Disk: a stage removes the tables between its steps that its result does not read.  Those that it does read go when a
later stage of the same thread and sf_dir begins, as results are written by then, unless that stage's docs read them.

Defined results: a null doc_id is an id like any other, but the last choice when one row of a group of
near-duplicates stays; rows that repeat an id are documents of their own; null texts fail the quality rules; an
empty table stays empty; columns beyond those of documents are left out.
"""

from __future__ import annotations

import functools
import threading
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.llm import langid, packing, perplexity, simhash, substring
from quire.llm.common import discard, read_by, scope, table, write_shared

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Least posterior of the predicted language; undetermined texts have score 0.
LEAST_SCORE = 0.5

#: No stage but near-dedup's joins can be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the counted rules and lie in their language's perplexity band."""
    return perplexity.judge(docs, keep=COLUMNS).where("kept").select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    found = langid.identify(docs, model, keep={c: F.col(c) for c in COLUMNS}, text_in="text")
    return found.where((F.col("lang_pred") != langid.UND) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group of near-duplicates."""
    return simhash.representatives(docs, COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of repeated passages."""
    got = substring.remove_repeats(docs, keep=("doc_id", "lang", "source"))
    return got.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in token sequences."""
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


class _Held(threading.local):
    """Shared folders that results of stages read, by sf_dir and number of the stage."""

    def __init__(self):
        self.by: dict[tuple[str, int], list[str]] = {}


_HELD = _Held()


def _tidy(i: int, stage: Callable) -> Callable:
    """The stage of this number, which removes what is no longer read."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        by = _HELD.by
        earlier = [p for key in list(by) if key[0] == sf_dir and key[1] < i for p in by.pop(key)]
        still = read_by(docs, earlier) if earlier else []
        discard(spark, [p for p in earlier if p not in still])
        with scope() as new:
            out = stage(spark, docs, sf_dir)
        held = read_by(out, new)
        discard(spark, [p for p in new if p not in held])
        by.setdefault((sf_dir, i), []).extend(still + held)
        return out

    return run


_NAMED = [("quality rules", quality), ("language ID", language), ("SimHash near-dedup", near_dedup), ("substring dedup", substring_dedup), ("packing", pack)]
STAGES = [(name, _tidy(i, stage)) for i, (name, stage) in enumerate(_NAMED)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        with scope() as new:
            if i < len(STAGES) - 1:
                docs = write_shared(docs, f"pipeline-{i + 1}")
        still = read_by(docs, before)
        discard(spark, [p for p in before if p not in still])  # the docs of this stage
        before = new + still
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
