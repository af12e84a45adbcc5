"""Lines to chapters.

A title line opens a section and is not part of its body; a section is a chapter if it has a body line; a
book without any gives one chapter, the last title with an empty body.  Order is always an explicit column.

A book that is one row (``segment``, ``toc``) is split, flagged and folded within the row: nothing is shuffled.
Books that come as lines (files) are numbered by window, or in two phases where one book is beyond a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quire.functions.text import FILE_NEWLINES, UNICODE_NEWLINES, strip
from quire.operators.titles import DEFAULT_TITLE, MAX_TITLE, is_title


def line_arrays(docs: DataFrame, book: str = "doc_id", text: str = "text", newlines: str = "unix") -> DataFrame:
    """(book, _p, _all): the lines of each text, and whether the last one has a line end; without null and empty texts."""
    cut = {"unix": "\n", "file": FILE_NEWLINES, "unicode": UNICODE_NEWLINES}[newlines]
    rows = docs.where(F.col(text) != "").select(F.col(book).alias("book"), F.split(F.col(text), cut, -1).alias("_p"))
    last_empty = F.element_at("_p", -1) == ""
    return rows.select("book", F.when(last_empty, F.slice("_p", F.lit(1), F.size("_p") - 1)).otherwise(F.col("_p")).alias("_p"), last_empty.alias("_all"))


def lines(docs: DataFrame, book: str = "doc_id", text: str = "text", newlines: str = "unix") -> DataFrame:
    """(book, line_no from 0, line, ended).  newlines: unix, file or unicode; a final line end opens no line."""
    rows = line_arrays(docs, book, text, newlines)
    rows = rows.select("book", "_all", F.size("_p").alias("_n"), F.posexplode("_p").alias("line_no", "line"))
    return rows.select(F.col("book").alias(book), F.col("line_no").cast("long").alias("line_no"), "line", (F.col("_all") | (F.col("line_no") < F.col("_n") - 1)).alias("ended"))


def line_range(rows: DataFrame, start: int, end: int) -> DataFrame:
    """Lines [start, end) of every book."""
    return rows.where((F.col("line_no") >= start) & (F.col("line_no") < end))


def _with_titles(docs: DataFrame, book: str, text: str, pattern: str | None, newlines: str, max_title: int, search: bool) -> DataFrame:
    """line_arrays and _t, the places (from 0) of title lines."""
    rows = line_arrays(docs, book, text, newlines)
    flags = F.transform("_p", lambda x, i: F.when(is_title(x, F.col("_all") | (i < F.size("_p") - 1), pattern, max_title, search), i))
    return rows.withColumn("_t", F.filter(flags, lambda i: i.isNotNull()))


def flag_titles(rows: DataFrame, pattern: str | None = None, max_title: int = MAX_TITLE, search: bool = False) -> DataFrame:
    return rows.withColumn("is_title", is_title(F.col("line"), F.col("ended"), pattern, max_title, search))


def _upto(book: str) -> Window:
    return Window.partitionBy(book).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)


def number_sections(flagged: DataFrame, book: str = "doc_id") -> DataFrame:
    """gid: how many titles have come, this line included."""
    return flagged.withColumn("gid", F.sum(F.col("is_title").cast("long")).over(_upto(book)))


def sections(numbered: DataFrame, book: str = "doc_id") -> DataFrame:
    """One row per section: book, gid, title, n_lines, body, whether it is a chapter or not."""
    body = F.expr("listagg(line, '\n') within group (order by line_no) filter (where not is_title)")
    return numbered.groupBy(book, "gid").agg(F.max(F.when(F.col("is_title"), strip(F.col("line")))).alias("title"), F.count(F.when(~F.col("is_title"), 1)).alias("n_lines"), body.alias("body"), F.min("line_no").alias("first_line"))


def chapters_of(found: DataFrame, book: str = "doc_id", default_title: str = DEFAULT_TITLE) -> DataFrame:
    """Sections that are chapters, numbered from 1."""
    w = Window.partitionBy(book)
    k = found.withColumns({"_mx": F.max("n_lines").over(w), "_mg": F.max("gid").over(w)})
    k = k.where((F.col("n_lines") > 0) | ((F.col("_mx") == 0) & (F.col("gid") == F.col("_mg"))))
    no = F.row_number().over(w.orderBy("gid"))
    body = F.coalesce("body", F.lit(""))
    return k.select(book, no.alias("chap_no"), F.coalesce("title", F.lit(default_title)).alias("title"), body.alias("body"), "n_lines", F.length(body).cast("long").alias("n_chars"))


def segment(docs: DataFrame, book: str = "doc_id", text: str = "text", pattern: str | None = None, newlines: str = "unix", max_title: int = MAX_TITLE, search: bool = False) -> DataFrame:
    """(book, chap_no, title, body, n_lines, n_chars); an empty or null text gives one empty chapter."""
    rows = _with_titles(docs, book, text, pattern, newlines, max_title, search)
    starts = F.concat(F.array(F.lit(-1)), F.col("_t"))
    n = F.size("_p")

    def section(at, k):
        """From the title at ``at`` (-1: the lines before any) up to the next."""
        end = F.coalesce(F.get(F.col("_t"), k), n)
        return F.struct(at.alias("at"), (end - at - 1).alias("n"))

    rows = rows.withColumn("_s", F.transform(starts, section))
    # sections with a body; if there are none, the last one
    full = F.filter("_s", lambda x: x["n"] > 0)
    rows = rows.withColumn("_k", F.when(F.exists("_s", lambda x: x["n"] > 0), full).otherwise(F.slice("_s", -1, 1)))

    def chapter(x, i):
        title = F.when(x["at"] < 0, F.lit(DEFAULT_TITLE)).otherwise(strip(F.get(F.col("_p"), x["at"])))
        body = F.array_join(F.slice("_p", x["at"] + 2, x["n"]), "\n")
        return F.struct((i + 1).alias("chap_no"), title.alias("title"), body.alias("body"), x["n"].cast("long").alias("n_lines"))

    got = rows.select(F.col("book").alias(book), F.inline(F.transform("_k", chapter))).withColumn("n_chars", F.length("body").cast("long"))
    bare = docs.where(F.coalesce(F.col(text), F.lit("")) == "").select(F.col(book), F.lit(1).alias("chap_no"), F.lit(DEFAULT_TITLE).alias("title"), F.lit("").alias("body"), F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_chars"))
    return got.unionByName(bare)


def toc(docs: DataFrame, book: str = "doc_id", text: str = "text", pattern: str | None = None, max_title: int = MAX_TITLE, search: bool = False) -> DataFrame:
    """toc_index of texts that are rows (each line end is one byte)."""
    rows = _with_titles(docs, book, text, pattern, "unix", max_title, search)

    def step(acc, i):
        """Bytes from the title before (or the start) to this one."""
        size = F.octet_length(F.array_join(F.slice("_p", acc["line"] + 1, i - acc["line"]), "\n"))
        at = acc["at"] + size + F.when(i > acc["line"], 1).otherwise(0)
        return F.struct(i.alias("line"), at.cast("long").alias("at"), F.concat(acc["out"], F.array(at.cast("long"))).alias("out"))

    zero = F.struct(F.lit(0).alias("line"), F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
    total = F.octet_length(F.array_join("_p", "\n")) + F.col("_all").cast("int")
    rows = rows.select("book", "_p", "_t", F.aggregate("_t", zero, step, lambda acc: acc["out"]).alias("_o"), total.cast("long").alias("_e"))

    def entry(o, k):
        title = strip(F.get(F.col("_p"), F.get(F.col("_t"), k)))
        return F.struct((k + 1).alias("chap_no"), title.alias("title"), o.alias("start"), F.coalesce(F.get(F.col("_o"), k + 1), F.col("_e")).alias("end"))

    return rows.select(F.col("book").alias(book), F.inline(F.transform("_o", entry)))


def split_ids(rows: DataFrame, book: str, size: int) -> DataFrame:
    """part: which piece of ``size`` lines a line lies in."""
    return rows.withColumn("part", F.floor(F.col("line_no") / size))


def number_sections_two_phase(flagged: DataFrame, book: str = "doc_id", size: int = 50_000) -> DataFrame:
    """number_sections for books beyond one task: titles are counted within pieces, then across them.

    Only the second step sees a whole book, as one row per piece.
    """
    parts = split_ids(flagged, book, size)
    counts = parts.groupBy(book, "part").agg(F.sum(F.col("is_title").cast("long")).alias("_t"))
    before = Window.partitionBy(book).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(book, "part", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy(book, "part").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    local = parts.withColumn("_g", F.sum(F.col("is_title").cast("long")).over(inside))
    return local.join(offsets, [book, "part"]).withColumn("gid", F.col("_g") + F.col("_o")).drop("_g", "_o", "part")


def byte_index(rows: DataFrame, book: str = "doc_id") -> DataFrame:
    """offset of each line in the UTF-8 text (each line end is one byte)."""
    w = Window.partitionBy(book).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum(F.octet_length("line") + 1).over(w), F.lit(0)))


def toc_index(flagged: DataFrame, book: str = "doc_id") -> DataFrame:
    """(book, chap_no, title, start, end): byte ranges of titled sections, the title line included."""
    at = byte_index(flagged, book)
    w = Window.partitionBy(book)
    at = at.withColumn("total", F.max(F.col("offset") + F.octet_length("line") + F.col("ended").cast("int")).over(w)).where("is_title")
    order = w.orderBy("line_no")
    return at.select(book, F.row_number().over(order).alias("chap_no"), strip(F.col("line")).alias("title"), F.col("offset").alias("start"), F.coalesce(F.lead("offset").over(order), F.col("total")).alias("end"))


def read_range(content: Column, start: Column, end: Column) -> Column:
    """Bytes [start, end) of binary content as text."""
    return F.substring(content, start + 1, end - start).cast("string")


# ---- edits


def move(chapters: DataFrame, frm: int, to: int, book: str = "doc_id") -> DataFrame:
    """Chapter number ``frm`` of every book that has both goes to place ``to``; the ones between close up."""
    n = F.max("chap_no").over(Window.partitionBy(book))
    c = F.col("chap_no")
    if frm < to:
        moved = F.when(c == frm, to).when((c > frm) & (c <= to), c - 1).otherwise(c)
    else:
        moved = F.when(c == frm, to).when((c >= to) & (c < frm), c + 1).otherwise(c)
    return chapters.withColumn("chap_no", F.when(n >= max(frm, to), moved).otherwise(c))


def delete_into_previous(chapters: DataFrame, which: Column, book: str = "doc_id") -> DataFrame:
    """Bodies of the chapters where ``which`` holds go to the chapter before, after a newline; the first stays."""
    w = Window.partitionBy(book).orderBy("chap_no")
    keep = (F.row_number().over(w) == 1) | ~F.coalesce(which, F.lit(False))
    k = chapters.withColumn("_k", keep).withColumn("_g", F.sum(F.col("_k").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    body = F.expr("listagg(body, '\n') within group (order by chap_no)")
    out = k.groupBy(book, F.col("_g").alias("chap_no")).agg(F.max(F.when(F.col("_k"), F.col("title"))).alias("title"), body.alias("body"), F.sum("n_lines").alias("n_lines"))
    return out.withColumn("n_chars", F.length("body").cast("long"))


def volume_of(chap_no: Column, most: int) -> Column:
    """Physical volume (from 1) of a chapter when no volume holds more than ``most``; 0 or less: one volume."""
    return F.lit(1) if most <= 0 else (F.floor((chap_no - 1) / most) + 1).cast("int")


def chunk_count(size: Column, sweet_spot: int = 256 << 20) -> Column:
    return F.greatest(F.lit(1), F.ceil(size / sweet_spot)).cast("int")


#: fixed values: files below so many MB are cut in so many chunks
CHUNK_TABLE = ((5, 1), (15, 2), (50, 4), (200, 4))


def chunk_count_by_table(size: Column) -> Column:
    mb, out = size / (1 << 20), None
    for below, n in CHUNK_TABLE:
        out = F.when(mb < below, n) if out is None else out.when(mb < below, n)
    return out.otherwise(6)


def even_part(line_no: Column, n_lines: Column, parts: int) -> Column:
    """Piece of a line when lines are dealt evenly and the last piece takes the rest."""
    size = F.greatest(F.lit(1), F.floor(n_lines / parts))
    return F.least(F.floor(line_no / size), F.lit(parts - 1)).cast("int")
