"""Volumes from title statistics: which units contain chapters, and which chapters they contain."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from quire.functions.text import strip


@dataclass(frozen=True)
class Rules:
    # ---- fixed values: units, their levels, and the guards that tell a marker line from prose
    units: tuple[str, ...] = ("卷", "部", "篇", "集", "章", "回", "节")
    level: dict[str, int] = field(default_factory=lambda: {"卷": 6, "部": 5, "篇": 4, "集": 3, "章": 2, "回": 1, "节": 0})
    containers: str = "卷部篇集"
    ratio: float = 2
    noise_when_chapter: tuple[str, ...] = ("节",)
    max_len: int = 20
    body_words: tuple[str, ...] = ("章", "回", "节")
    end_words: tuple[str, ...] = ("完", "终", "尾声", "结束")
    prose: str = "。，、！？；：\"\"''（）【】《》〈〉—…·~～"
    trim: str = "【】()（）[] 　\t\r"
    numeral: str = "[0-9零一二三四五六七八九十百千]"
    chapter_units: tuple[str, ...] = ("章", "回")
    leading: str = "正文"


DEFAULT = Rules()


def compact(title: Column, rules: Rules = DEFAULT) -> Column:
    return F.translate(strip(title), rules.trim, "")


def _marker(units: str, rules: Rules) -> str:
    return f"(?U)第\\s*{rules.numeral}+\\s*([{units}])"


def is_container(title: Column, rules: Rules = DEFAULT) -> Column:
    c = compact(title, rules)
    bad = "|".join(map(re.escape, (*rules.body_words, *rules.end_words, *rules.prose)))
    return c.rlike(f"(?U)\\A第\\s*{rules.numeral}+\\s*[{rules.containers}]") & ~c.rlike(bad) & (F.length(c) <= rules.max_len)


def container_unit(title: Column, rules: Rules = DEFAULT) -> Column:
    """The highest unit of a container line, else null."""
    level = F.create_map(*[F.lit(x) for u in rules.containers for x in (u, rules.level.get(u, 0))])
    found = F.regexp_extract_all(compact(title, rules), F.lit(_marker(rules.containers, rules)), F.lit(1))
    best = F.array_max(F.transform(found, lambda u: F.struct(F.element_at(level, u).alias("l"), u.alias("u"))))
    return F.when(is_container(title, rules), best["u"])


def unit_counts(index: DataFrame, book: str = "book", title: str = "title", rules: Rules = DEFAULT) -> DataFrame:
    """(book, unit, n): every occurrence of a numbered unit in titles."""
    units = F.regexp_extract_all(compact(F.col(title), rules), F.lit(_marker("".join(rules.units), rules)), F.lit(1))
    return index.select(book, F.explode(units).alias("unit")).groupBy(book, "unit").agg(F.count(F.lit(1)).alias("n"))


def _judged(index: DataFrame, book: str, order: str, title: str, rules: Rules) -> DataFrame:
    """Rows of the index (book, idx, t) with unit, n, n_chapters, has_chapter, accepted: one shuffle, by book."""
    chap = _marker("".join(rules.chapter_units), rules)
    t = index.select(F.col(book).alias("book"), F.col(order).alias("idx"), F.col(title).alias("t"), container_unit(F.col(title), rules).alias("unit"), compact(F.col(title), rules).rlike(chap).alias("_c"))
    w = Window.partitionBy("book")
    t = t.repartition("book").withColumns({"n_chapters": F.count(F.when(F.col("unit").isNull(), 1)).over(w), "has_chapter": F.max("_c").over(w), "n": F.count("unit").over(Window.partitionBy("book", "unit"))})
    noise = F.col("unit").isin(*rules.noise_when_chapter) & F.col("has_chapter")
    return t.withColumn("accepted", F.coalesce(F.col("unit").isNotNull() & ~noise & (F.col("n") * rules.ratio <= F.col("n_chapters")), F.lit(False)))


def analyze(index: DataFrame, book: str = "book", title: str = "title", rules: Rules = DEFAULT) -> DataFrame:
    """(book, unit, n, n_chapters, has_chapter, accepted) for every container unit of a book."""
    got = _judged(index, book, title, title, rules).where("unit is not null")
    return got.groupBy(F.col("book").alias(book), "unit").agg(*[F.first(c).alias(c) for c in ("n", "n_chapters", "has_chapter", "accepted")])


def groups(index: DataFrame, book: str = "book", order: str = "idx", title: str = "title", rules: Rules = DEFAULT) -> DataFrame:
    """(book, group_no, volume_title, members): books without an accepted unit give no row.

    The first member of a volume is its own marker line; entries before the first volume form a group of
    their own, number 0.
    """
    w = Window.partitionBy("book")
    t = _judged(index, book, order, title, rules).withColumn("_some", F.max("accepted").over(w)).where("_some")
    t = t.withColumn("group_no", F.sum(F.col("accepted").cast("int")).over(w.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)))
    got = t.groupBy("book", "group_no").agg(F.coalesce(F.max(F.when(F.col("accepted"), F.col("t"))), F.lit(rules.leading)).alias("volume_title"), F.array_sort(F.collect_list("idx")).alias("members"))
    return got.withColumnRenamed("book", book)


def fixed_priority_unit(index: DataFrame, book: str = "book", title: str = "title", priority: str = "卷部篇集章", rules: Rules = DEFAULT) -> DataFrame:
    """(book, unit): the older choice, the first unit of a fixed order that a book's titles have."""
    n = unit_counts(index, book, title, rules).where(F.col("unit").isin(*priority))
    rank = F.instr(F.lit(priority), F.col("unit"))
    return n.groupBy(book).agg(F.min_by("unit", rank).alias("unit"))
