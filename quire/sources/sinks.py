"""Files out: CSV with a byte-order mark, JSON lines, reports, binary files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

BOM = "﻿"


def write_csv(df: DataFrame, path: str, columns: Sequence[str], order: Sequence[str]) -> None:
    """One CSV file with the given columns, sorted, UTF-8 with a byte-order mark.  For reports: all rows go to one file."""
    df.select(F.col(columns[0]).alias(BOM + columns[0]), *columns[1:]).orderBy(*[BOM + c if c == columns[0] else c for c in order]).coalesce(1).write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def markdown(df: DataFrame, title: str, rows: int = 200) -> str:
    """A small table as Markdown; ``rows`` is the report's length, and the last line says how many are left out."""
    head = df.columns
    got = df.limit(rows + 1).collect()
    more = df.count() - rows if len(got) > rows else 0
    line = lambda cells: "| " + " | ".join("" if c is None else str(c).replace("|", "\\|") for c in cells) + " |"
    return "\n".join([f"## {title}", "", line(head), line(["-"] * len(head)), *map(line, got[:rows]), *([f"{more} more rows"] if more else []), ""])


def write_books(books: DataFrame, path: str, name: Column, content: str = "epub") -> DataFrame:
    """(file, ok, error) after writing each row's bytes as ``path/name`` through the Hadoop file system.

    Executors have no Hadoop client in Python, so bytes are written there only to folders that are mounted;
    elsewhere keep the table: it holds the same bytes.
    """
    import os

    root = path.removeprefix("file://")
    rows = books.select(name.alias("file"), F.col(content).alias("raw"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for file, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    target = os.path.join(root, file)
                    os.makedirs(os.path.dirname(target), exist_ok=True)
                    with open(target + ".part", "wb") as f:
                        f.write(raw or b"")
                    os.replace(target + ".part", target)
                    out.append((file, True, ""))
                except OSError as e:
                    out.append((file, False, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ((), (), ()), (pa.string(), pa.bool_(), pa.string()))], ["file", "ok", "error"])

    return rows.mapInArrow(run, "file string, ok boolean, error string")
