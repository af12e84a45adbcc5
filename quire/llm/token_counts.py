"""Exact length histogram of encoded documents, and what suffix sums over it answer.

One row per distinct length: how many documents have it, and for the context limit equal to that length
the documents and tokens at or beyond it, the totals with every document cut at it, and the share of
documents and tokens up to it (which gives every quantile).  Between two rows all of these follow from
the next row, so the table answers every limit.

Defined results: null text counts as empty, length 0; an empty table gives no row; ties are one row;
other input columns are left out.  The suffix sums run in two levels (lengths in blocks of ``BLOCK``,
then the blocks), so that no single task orders all lengths.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, Window, functions as F

from quire.llm.bpe import read_ranks
from quire.llm.chunks import PATTERN, Chunked
from quire.llm.common import batches, columns_of, write_shared

BLOCK = 4096


@functools.lru_cache(maxsize=2)
def _counter(path: str, pattern: str) -> Callable[[str], list[int]]:
    encode = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={}).encode_ordinary
    if pattern != PATTERN:
        return lambda text: [len(encode(text))]
    return Chunked(lambda c: len(encode(c)), lambda c: len(encode(" " + c)))


def count_tokens(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """Columns ``keep`` (name -> Column) and n_tokens.  Every executor reads the rank file at its path."""
    keep = keep or {}
    part = df.select(*[c.alias(f"k{i}") for i, c in enumerate(keep.values())], F.col(text_col).alias("_t"))
    fields = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in part.schema.fields[:-1])

    def run(rows):
        counter = _counter(ranks_path, pattern)
        for b in batches(rows):
            n = [sum(counter(t)) if t else 0 for t in columns_of(b, "_t")[0]]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], [*b.schema.names[:-1], "n_tokens"])

    return part.mapInArrow(run, f"{fields}n_tokens bigint").select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keep)], "n_tokens")


def histogram(counts: DataFrame, col: str = "n_tokens") -> DataFrame:
    """n_tokens, n_docs: one row per distinct length."""
    return counts.groupBy(F.col(col).alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs"))


def limits(hist: DataFrame) -> DataFrame:
    """Suffix sums over a histogram (n_tokens, n_docs), which is written once: it is used twice."""
    hist = write_shared(hist, "lengths")
    h = hist.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"), F.floor(F.col("n_tokens") / BLOCK).alias("block"))
    later = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    blocks = blocks.select(F.col("block").alias("b"), F.coalesce(F.sum("d").over(later), F.lit(0)).alias("docs_after"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("tokens_after"), F.sum("d").over(every).alias("docs_all"), F.sum("t").over(every).alias("tokens_all"))
    inside = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, 0)
    s = h.join(blocks, h.block == blocks.b).withColumns({"docs_ge": F.sum("n_docs").over(inside) + F.col("docs_after"), "tokens_ge": F.sum("tokens").over(inside) + F.col("tokens_after")})
    return s.select(
        "n_tokens",
        "n_docs",
        "docs_ge",
        "tokens_ge",
        (F.col("tokens_all") - F.col("tokens_ge") + F.col("n_tokens") * F.col("docs_ge")).alias("truncated_tokens"),
        (F.col("tokens_ge") - F.col("n_tokens") * F.col("docs_ge")).alias("lost_tokens"),
        ((F.col("docs_all") - F.col("docs_ge") + F.col("n_docs")) / F.col("docs_all")).alias("docs_share"),
        F.when(F.col("tokens_all") > 0, (F.col("tokens_all") - F.col("tokens_ge") + F.col("tokens")) / F.col("tokens_all")).otherwise(1.0).alias("tokens_share"),
        "docs_all",
        "tokens_all",
    )


def quantile(answers: DataFrame, q: float) -> DataFrame:
    """The least length that a share q of the documents do not exceed."""
    return answers.where(F.col("docs_share") >= q).agg(F.min("n_tokens").alias("n_tokens"))


def truncated_total(answers: DataFrame, limit: int) -> DataFrame:
    """Tokens that stay when every document is cut at ``limit``."""
    below = answers.where(F.col("n_tokens") < limit).agg(F.sum(F.col("n_tokens") * F.col("n_docs")).alias("a"))
    above = answers.where(F.col("n_tokens") >= limit).agg(F.sum("n_docs").alias("n"))
    return below.crossJoin(above).select((F.coalesce("a", F.lit(0)) + limit * F.coalesce("n", F.lit(0))).alias("tokens"))
