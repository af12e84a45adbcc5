"""spark-submit quire/cli.py -i FOLDER... -o FOLDER: text files to EPUB books."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession, functions as F

from quire.operators.titles import rule_pattern
from quire.plans.convert import convert
from quire.sources.files import read_rules
from quire.sources.sinks import write_books


def arguments(argv: Sequence[str] | None = None) -> argparse.Namespace:
    a = argparse.ArgumentParser(description=__doc__)
    a.add_argument("-i", "--input", nargs="+", required=True, help="folders or files")
    a.add_argument("-o", "--output", required=True, help="folder, mounted where executors run")
    a.add_argument("-t", "--title", help="title of all books; else the file's name")
    a.add_argument("-a", "--author", default="")
    a.add_argument("--encoding", default="auto")
    a.add_argument("--max-per-volume", type=int, default=0, help="chapters of a volume, 0: one volume")
    a.add_argument("--no-volume", action="store_true", help="flat table of contents")
    a.add_argument("--hierarchy", choices=("default", "legacy"), default="default", help="volumes from statistics, or by a fixed order of units")
    a.add_argument("--cover", help="JPEG file")
    a.add_argument("--no-recursive", action="store_true")
    a.add_argument("--rules", help="rule table (JSON)")
    a.add_argument("--rule", help="name of the rule that finds titles")
    return a.parse_args(argv)


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    """0: all books were written; 1: some failed."""
    a = arguments(argv)
    spark = spark or SparkSession.builder.appName("quire").getOrCreate()
    pattern = rule_pattern(read_rules(spark, a.rules), a.rule) if a.rules and a.rule else None
    cover = None
    if a.cover:
        with open(a.cover, "rb") as f:
            cover = f.read()
    engine = "none" if a.no_volume else "fixed" if a.hierarchy == "legacy" else "default"
    books = convert(spark, a.input, a.output, a.title, a.author, pattern, a.max_per_volume, engine, cover, None if a.encoding == "auto" else a.encoding, not a.no_recursive)
    books = books.select("path", F.regexp_extract("out_path", r"([^/]*)$", 1).alias("name"), "success", "error", "epub")
    done = write_books(books.where("success"), a.output, F.col("name")).where("ok").count()
    failed = books.where("not success").select("path", "error")
    for r in failed.limit(100).toLocalIterator():  # a report
        print(f"failed: {r.path}: {r.error}", file=sys.stderr)
    lost = failed.count()
    print(f"{done} books written, {lost} failed")
    return 1 if lost else 0


if __name__ == "__main__":
    sys.exit(main())
