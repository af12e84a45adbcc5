"""Segmentation against a plain loop, whatever the lines and the cuts."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import segment as sg
from quire.operators.titles import DEFAULT_TITLE

PATTERN = "^T\\d"


def plain(text):
    """Chapters of a text by one pass over its lines."""
    out, body, title = [], [], DEFAULT_TITLE
    lines = text.split("\n")
    if lines[-1] == "":
        lines.pop()
    for i, line in enumerate(lines):
        ended = i < len(lines) - 1 or text.endswith("\n")
        bare = line.lstrip()
        if bare and len(bare) + ended < 80 and line[:1] == "T" and line[1:2].isdigit():
            if body:
                out.append((title, "\n".join(body)))
                body = []
            title = line.strip()
        else:
            body.append(line)
    if body or not out:
        out.append((title, "\n".join(body)))
    return out


CASES = ["", "T1", "T1\n", "T1\nT2", "T1\nT2\nx", "x\nT1", "x\nT1\n\nT2\ny\n", "\n", "\n\n", "a\nb\nc", "T1 " + "z" * 75 + "\nx", "T1 " + "z" * 76 + "\nx", "T1 " + "z" * 76, "T1 " + "z" * 77, " T1\nx", "T1  \nx\n"]


@pytest.fixture(scope="module")
def books(spark):
    rng = random.Random(7)
    texts = CASES + ["".join(rng.choice(["T1\n", "T2 b\n", "x\n", "\n", "  y z\n", "T3"]) for _ in range(rng.randint(0, 9))) for _ in range(120)]
    return texts, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def as_lists(df):
    got = {}
    for r in df.orderBy("doc_id", "chap_no").collect():
        got.setdefault(r.doc_id, []).append((r.title, r.body))
    return got


def test_segment_equals_plain_loop(books):
    texts, df = books
    assert as_lists(sg.segment(df, pattern=PATTERN)) == {i: plain(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("size", [1, 2, 3, 100])
def test_any_split_gives_the_same_sections(books, size):
    _, df = books
    flagged = sg.flag_titles(sg.lines(df), PATTERN)
    whole = sg.number_sections(flagged).select("doc_id", "line_no", "gid")
    parts = sg.number_sections_two_phase(flagged, size=size).select("doc_id", "line_no", "gid")
    assert whole.exceptAll(parts).isEmpty() and parts.exceptAll(whole).isEmpty()


def test_null_text_and_empty_table(spark):
    df = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert as_lists(sg.segment(df)) == {1: [(DEFAULT_TITLE, "")]}
    assert sg.segment(df.where("false")).count() == 0


def test_newline_rules(spark):
    df = spark.createDataFrame([(1, "a\r\nb\rc\x0bd e\n")], "doc_id long, text string")
    n = {k: sg.lines(df, newlines=k).count() for k in ("unix", "file", "unicode")}
    assert n == {"unix": 2, "file": 3, "unicode": 5}
    assert sg.lines(df, newlines="unicode").count() == len("a\r\nb\rc\x0bd e\n".splitlines())


def test_default_titles(spark):
    yes = ["第一章 开始", "第 12 章", "　第三回合之卷一卷", "番外", "Ⅰ. x", "引子", "第一卷", "1、开端", "正文", "====", "第十部", "第九节"]
    no = ["正文完", "第九节课", "第三部分", "他走了很久很久才到", "第一集合", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(yes + no)], "doc_id long, text string")
    got = {r.doc_id for r in sg.flag_titles(sg.lines(df)).where("is_title").collect()}
    expected = {i for i, t in enumerate(yes) if t not in ("　第三回合之卷一卷", "Ⅰ. x")}
    assert expected <= got and not got & set(range(len(yes), len(yes) + len(no)))


def test_move_and_delete(spark):
    c = spark.createDataFrame([(1, i, f"t{i}", f"b{i}", 1, 2) for i in range(1, 5)], "doc_id long, chap_no int, title string, body string, n_lines long, n_chars long")
    assert [r.title for r in sg.move(c, 4, 2).orderBy("chap_no").collect()] == ["t1", "t4", "t2", "t3"]
    assert [r.title for r in sg.move(c, 1, 3).orderBy("chap_no").collect()] == ["t2", "t3", "t1", "t4"]
    assert [r.title for r in sg.move(c, 1, 9).orderBy("chap_no").collect()] == ["t1", "t2", "t3", "t4"]
    d = sg.delete_into_previous(c, F.col("chap_no").isin(1, 2, 4)).orderBy("chap_no").collect()
    assert [(r.title, r.body) for r in d] == [("t1", "b1\nb2"), ("t3", "b3\nb4")]


def test_toc_ranges_read_back(spark):
    text = "前言行\nT1 甲\n正文é\nT2\nx"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    toc = sg.toc_index(sg.flag_titles(sg.lines(df), PATTERN)).join(df, "doc_id")
    got = [r.t for r in toc.orderBy("chap_no").select(sg.read_range(F.col("text").cast("binary"), F.col("start").cast("int"), F.col("end").cast("int")).alias("t")).collect()]
    assert got == ["T1 甲\n正文é\n", "T2\nx"]
