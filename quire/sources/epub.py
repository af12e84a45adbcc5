"""Books out: EPUB packages built on executors, one row per book, and their check."""

from __future__ import annotations

import html
import io
import uuid
import zipfile

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quire.functions.text import paragraphs

CSS = "body{margin:5%;line-height:1.6}h2.head{text-align:center;margin:2em 0}p{text-indent:2em;margin:.4em 0}"
_CONTAINER = '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="EPUB/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'


def _page(title: str, body: str, lang: str) -> str:
    return f'<?xml version="1.0" encoding="utf-8"?><!DOCTYPE html><html xmlns="http://www.w3.org/1999/xhtml" xml:lang="{lang}"><head><title>{title}</title><link rel="stylesheet" href="style.css"/></head><body>{body}</body></html>'


def build(chapters: list[tuple[str, str]], title: str, author: str = "", lang: str = "zh-CN", cover: bytes | None = None, groups: list[tuple[str, list[int]]] | None = None, uid: str | None = None) -> bytes:
    """chapters: (title, rendered paragraphs).  groups nest the table of contents: (title, chapter indexes)."""
    t, a = html.escape(title), html.escape(author)
    uid = uid or str(uuid.uuid5(uuid.NAMESPACE_URL, f"{title}\0{author}\0{len(chapters)}"))
    names = [f"chap_{i:03d}.xhtml" for i in range(1, len(chapters) + 1)]
    heads = [html.escape(c[0]) for c in chapters]

    def entry(i: int, more: str = "") -> str:
        return f'<li><a href="{names[i]}">{heads[i]}</a>{more}</li>'

    if groups:
        toc = ""
        for head, members in groups:
            own = members and chapters[members[0]][0] == head
            inner = "".join(entry(i) for i in (members[1:] if own else members))
            toc += entry(members[0], f"<ol>{inner}</ol>" if inner else "") if own else f"<li><span>{html.escape(head)}</span><ol>{inner}</ol></li>"
    else:
        toc = "".join(map(entry, range(len(chapters))))
    items = ['<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>', '<item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>', '<item id="css" href="style.css" media-type="text/css"/>']
    items += [f'<item id="c{i}" href="{n}" media-type="application/xhtml+xml"/>' for i, n in enumerate(names)]
    spine = [f'<itemref idref="c{i}"/>' for i in range(len(names))]
    if cover:
        items += ['<item id="cover-image" href="cover.jpg" media-type="image/jpeg" properties="cover-image"/>', '<item id="cover" href="cover.xhtml" media-type="application/xhtml+xml"/>']
        spine.insert(0, '<itemref idref="cover"/>')
    opf = f'<?xml version="1.0" encoding="utf-8"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">urn:uuid:{uid}</dc:identifier><dc:title>{t}</dc:title><dc:creator>{a}</dc:creator><dc:language>{lang}</dc:language></metadata><manifest>{"".join(items)}</manifest><spine toc="ncx">{"".join(spine)}</spine></package>'
    points = "".join(f'<navPoint id="n{i}" playOrder="{i + 1}"><navLabel><text>{h}</text></navLabel><content src="{n}"/></navPoint>' for i, (h, n) in enumerate(zip(heads, names)))
    ncx = f'<?xml version="1.0" encoding="utf-8"?><ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><head><meta name="dtb:uid" content="urn:uuid:{uid}"/></head><docTitle><text>{t}</text></docTitle><navMap>{points}</navMap></ncx>'
    nav = _page(t, f'<nav xmlns:epub="http://www.idpf.org/2007/ops" epub:type="toc"><h1>{t}</h1><ol>{toc}</ol></nav>', lang)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:

        def put(name: str, data: str | bytes, how: int = zipfile.ZIP_DEFLATED) -> None:
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data, how)  # the same book gives the same bytes

        put("mimetype", "application/epub+zip", zipfile.ZIP_STORED)
        put("META-INF/container.xml", _CONTAINER)
        put("EPUB/style.css", CSS)
        put("EPUB/content.opf", opf)
        put("EPUB/toc.ncx", ncx)
        put("EPUB/nav.xhtml", nav)
        if cover:
            put("EPUB/cover.jpg", cover)
            put("EPUB/cover.xhtml", _page(t, f'<img src="cover.jpg" alt="{t}"/>', lang))
        for name, head, (_, body) in zip(names, heads, chapters):
            put(f"EPUB/{name}", _page(head, f'<h2 class="head">{head}</h2>\n{body}', lang))
    return out.getvalue()


def package(chapters: DataFrame, book: str = "book_id", title: Column | None = None, author: Column | None = None, lang: str = "zh-CN", cover: Column | None = None, groups: DataFrame | None = None) -> DataFrame:
    """(book, epub, chapter_count, error): a book that fails gives its error, the others go on.

    groups: (book, group_no, volume_title, members), members by chap_no; books that have rows get a nested table of
    contents.  One row per book crosses to Python, in Arrow batches.
    """
    head = {"title": title if title is not None else F.col(book).cast("string"), "author": author if author is not None else F.lit(""), "cover": cover if cover is not None else F.lit(None).cast("binary")}
    part = F.struct(F.col("chap_no").cast("long").alias("no"), F.col("title").alias("head"), paragraphs(F.col("body")).alias("body"))
    rows = chapters.select(F.col(book).alias("book"), part.alias("c"), *[c.alias(f"b_{k}") for k, c in head.items()])
    books = rows.groupBy("book").agg(F.collect_list("c").alias("c"), *[F.first(f"b_{k}").alias(k) for k in head])
    nested = "array<struct<no:bigint,title:string,members:array<bigint>>>"
    if groups is not None:
        volume = F.struct(F.col("group_no").cast("long").alias("no"), F.col("volume_title").alias("title"), F.col("members").cast("array<bigint>").alias("members"))
        books = books.join(groups.groupBy(F.col(book).alias("book")).agg(F.array_sort(F.collect_list(volume)).alias("g")), "book", "left")
    else:
        books = books.withColumn("g", F.lit(None).cast(nested))

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                name, found, t, a, image, volumes = (b.column(j)[i].as_py() for j in range(6))
                found.sort(key=lambda c: c["no"])
                try:
                    place = {c["no"]: k for k, c in enumerate(found)}
                    toc = [(v["title"], [place[m] for m in v["members"] if m in place]) for v in volumes or ()]
                    data, error = build([(c["head"], c["body"]) for c in found], t, a or "", lang, image, toc or None), ""
                except Exception as e:
                    data, error = None, f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array([data], pa.binary()), pa.array([len(found)], pa.int32()), pa.array([error])], ["book", "epub", "chapter_count", "error"])

    kind = rows.schema["book"].dataType.simpleString()
    return books.select("book", "c", "title", "author", "cover", "g").mapInArrow(run, f"book {kind}, epub binary, chapter_count int, error string").withColumnRenamed("book", book)


def is_valid(content: Column) -> Column:
    """A zip that has a mimetype entry and something in META-INF."""

    @F.pandas_udf("boolean")
    def run(raw: pd.Series) -> pd.Series:
        def ok(b) -> bool:
            try:
                names = zipfile.ZipFile(io.BytesIO(bytes(b))).namelist()
            except (zipfile.BadZipFile, TypeError, ValueError):
                return False
            return "mimetype" in names and any(n.startswith("META-INF/") for n in names)

        return raw.map(ok)

    return run(content)


def crop_cover(content: Column, box: tuple[int, int, int, int] | None = None, most: tuple[int, int] = (600, 800), quality: int = 85) -> Column:
    """JPEG of the box, no larger than ``most``; null where the image cannot be read (or no image library is there)."""

    @F.pandas_udf("binary")
    def run(raw: pd.Series) -> pd.Series:
        def one(b):
            try:
                from PIL import Image

                image = Image.open(io.BytesIO(bytes(b))).convert("RGB")
                image = image.crop(box) if box else image
                image.thumbnail(most, Image.LANCZOS)
                out = io.BytesIO()
                image.save(out, "JPEG", quality=quality)
                return out.getvalue()
            except Exception:
                return None

        return raw.map(one)

    return run(content)
