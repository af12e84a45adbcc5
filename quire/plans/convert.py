"""Whole conversions: files or texts to chapters, volumes and packaged books."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.functions.text import stem
from quire.operators import hierarchy, segment
from quire.operators.runs import unique_paths
from quire.operators.titles import DEFAULT_TITLE
from quire.sources import epub, files


def chapters_of_files(spark: SparkSession, roots: Sequence[str], pattern: str | None = None, limit: int = 512 * 1024, split_lines: int = 50_000, encoding: str | None = None, recursive: bool = True) -> tuple[DataFrame, DataFrame]:
    """(books, chapters) of all text files under the roots; ``encoding`` stands for detection.

    Titles are numbered in two phases, in pieces of ``split_lines`` lines (0: in one phase, a book a task).  A file
    that cannot be read has a book, with ``error``, and no chapter.
    """
    found = files.scan_files(spark, roots, recursive=recursive)
    books = files.detect(found.withColumn("declared", F.lit(encoding)) if encoding else found, limit)
    bad = files.unreadable(books)
    books = books.join(bad, "book_id", "left").withColumn("error", F.coalesce("error", F.lit("")))
    good = books.where("error = ''")
    flagged = segment.flag_titles(files.file_lines(good), pattern)
    numbered = segment.number_sections_two_phase(flagged, "book_id", split_lines) if split_lines else segment.number_sections(flagged, "book_id")
    chapters = segment.chapters_of(segment.sections(numbered, "book_id"), "book_id")
    bare = good.select("book_id").join(flagged.select("book_id").distinct(), "book_id", "left_anti")
    empty = bare.select("book_id", F.lit(1).alias("chap_no"), F.lit(DEFAULT_TITLE).alias("title"), F.lit("").alias("body"), F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_chars"))
    return books, chapters.unionByName(empty)


def convert(spark: SparkSession, roots: Sequence[str], out: str, title: str | None = None, author: str = "", pattern: str | None = None, max_chapters: int = 0, engine: str = "default", cover: bytes | None = None, encoding: str | None = None, recursive: bool = True) -> DataFrame:
    """Results: book_id, path, out_path, chapter_count, error, epub; ``max_chapters`` > 0 splits books into volumes.

    ``engine`` infers the volumes that nest the table of contents of an unsplit book ("none": no nesting).  ``cover``
    is the image of every book and of each of its volumes.  A file or book that fails is a row with its error.
    """
    books, chapters = chapters_of_files(spark, roots, pattern, encoding=encoding, recursive=recursive)
    volume = segment.volume_of(F.col("chap_no"), max_chapters)
    parts = chapters.withColumn("volume", volume).withColumn("key", F.concat_ws("/", F.col("book_id").cast("string"), F.col("volume").cast("string")))
    named = parts.join(books.select("book_id", F.col("path")), "book_id")
    name = F.lit(title) if title else stem(F.col("path"))
    head = F.when(F.lit(max_chapters > 0), F.concat(name, F.lit(" 第"), F.col("volume").cast("string"), F.lit("卷"))).otherwise(name)
    nested = None
    if max_chapters <= 0 and engine != "none":
        nested = volumes_of(chapters, "book_id", engine).withColumn("key", F.concat(F.col("book_id").cast("string"), F.lit("/1")))
    done = epub.package(named, "key", head, F.lit(author), cover=F.lit(cover).cast("binary"), groups=nested)
    done = done.select(F.split("key", "/")[0].cast("long").alias("book_id"), F.split("key", "/")[1].cast("int").alias("volume"), "epub", "chapter_count", "error")
    got = done.join(books.select("book_id", "path"), "book_id")
    lost = books.where("error <> ''").select("book_id", F.lit(1).alias("volume"), F.lit(None).cast("binary").alias("epub"), F.lit(0).alias("chapter_count"), "error", "path")
    got = got.unionByName(lost)
    tail = F.when(F.lit(max_chapters > 0), F.concat(F.lit("_卷"), F.col("volume").cast("string"))).otherwise(F.lit(""))
    got = got.withColumn("_stem", F.concat(stem(F.col("path")), tail))
    got = unique_paths(got, F.lit(out), F.col("_stem"), ".epub", [F.col("path"), F.col("volume")])
    return got.select("book_id", "path", "volume", "out_path", (F.col("error") == "").alias("success"), "chapter_count", "error", "epub")


def volumes_of(chapters: DataFrame, book: str = "book_id", engine: str = "default") -> DataFrame:
    """Inferred volumes of chapters; engine "none" gives no volumes."""
    if engine == "none":
        return hierarchy.groups(chapters.where("false"), book, "chap_no")
    if engine == "fixed":
        unit = hierarchy.fixed_priority_unit(chapters, book)
        own = chapters.join(unit, book)
        return hierarchy.groups(own.where("unit is not null").drop("unit"), book, "chap_no", rules=hierarchy.Rules(ratio=0))
    return hierarchy.groups(chapters, book, "chap_no")
