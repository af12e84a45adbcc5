"""String expressions with Unicode white-space rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Line ends of a text file, and the further ones that an in-memory string is split at.
FILE_NEWLINES = r"\r\n|[\n\r]"
UNICODE_NEWLINES = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
SPACE = r"[\s\x1c-\x1f\x85]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"(?U)\\A{SPACE}+|{SPACE}+\\z", "")


def lstrip(c: Column) -> Column:
    return F.regexp_replace(c, f"(?U)\\A{SPACE}+", "")


def xml_escape(c: Column) -> Column:
    c = F.replace(c, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(c, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def paragraphs(body: Column) -> Column:
    """One <p> per line that is not blank, stripped and escaped, joined by newlines."""
    lines = F.filter(F.transform(F.split(body, UNICODE_NEWLINES), strip), lambda x: x != "")
    return F.array_join(F.transform(lines, lambda x: F.concat(F.lit("<p>"), xml_escape(x), F.lit("</p>"))), "\n")


def count_of(c: Column, chars: str) -> Column:
    """How many code points of c are among chars."""
    return F.length(c) - F.length(F.translate(c, chars, ""))


def stem(path: Column) -> Column:
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def page(text: Column, number: int, first: int = 800, size: int = 2000) -> Column:
    """Preview page: number 0 is the first ``first`` code points, then pages of ``size``."""
    return F.substring(text, 1, first) if number == 0 else F.substring(text, first + (number - 1) * size + 1, size)


def pages(rows: DataFrame, key: str, text: str, first: int = 800, size: int = 2000) -> DataFrame:
    """(key, page, part): all preview pages of a text, to its end; an empty text has one empty page."""
    n = F.ceil(F.greatest(F.lit(0), F.length(text) - first) / size).cast("int")
    rows = rows.select(key, text, F.explode(F.sequence(F.lit(0), n)).alias("page"))
    part = F.when(F.col("page") == 0, F.substring(F.col(text), 1, first)).otherwise(F.substring(F.col(text), first + (F.col("page") - 1) * size + 1, F.lit(size)))
    return rows.select(key, "page", part.alias("part"))


def locate(text: Column, title: Column) -> Column:
    """struct<pos, line_no>: where a title stands, else its first word; line numbers from 1, null if absent."""
    word = F.get(F.split(title, r"\s+"), F.lit(0))
    at = F.instr(text, title)
    at = F.when(at > 0, at).otherwise(F.when(word != "", F.instr(text, word)).otherwise(F.lit(0)))
    before = F.substring(text, F.lit(1), at - 1)
    line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    return F.when(at > 0, F.struct(at.alias("pos"), line.alias("line_no")))
