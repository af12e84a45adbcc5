import pytest

from quire.operators import hierarchy as hi


def index(spark, titles):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(titles)], "book long, idx int, title string")


def members(df):
    return [(r.volume_title, list(r.members)) for r in df.orderBy("group_no").collect()]


def test_two_volumes(spark):
    t = ["第一卷"] + [f"第{i}章" for i in range(8)] + ["【第二卷】"] + [f"第{i}章" for i in range(8)]
    got = members(hi.groups(index(spark, t)))
    assert got == [("第一卷", list(range(9))), ("【第二卷】", list(range(9, 18)))]


def test_leading_chapters_have_their_own_group(spark):
    t = ["第1章", "第2章", "第一卷"] + [f"第{i}章" for i in range(5)]
    got = members(hi.groups(index(spark, t)))
    assert got[0] == ("正文", [0, 1]) and got[1][1][0] == 2
    assert sum(len(m) for _, m in got) == len(t)


def test_dense_units_are_rejected(spark):
    t = ["第一卷", "第1章", "第二卷", "第2章", "第三卷", "第3章"]
    assert members(hi.groups(index(spark, t))) == []
    a = hi.analyze(index(spark, t)).first()
    assert (a.unit, a.n, a.n_chapters, a.accepted) == ("卷", 3, 3, False)


def test_entries_without_a_unit_open_no_volume(spark):
    # no title has 章 or 回
    t = ["前言", "第一卷"] + [f"第{i}节" for i in range(1, 6)] + ["第二卷"] + [f"第{i}节" for i in range(1, 4)]
    assert members(hi.groups(index(spark, t))) == [("正文", [0]), ("第一卷", list(range(1, 7))), ("第二卷", list(range(7, 11)))]
    assert members(hi.groups(index(spark, ["第1节", "第2节", None, ""]))) == []
    assert members(hi.groups(index(spark, ["第一卷", "第1节"]))) == []


@pytest.mark.parametrize(
    "title, unit",
    [("第一篇 一夜 第一集 深夜", "篇"), ("【第一卷】", "卷"), ("第一卷终", None), ("继续阅读第三篇", None), ("第二卷，他说", None), ("第一卷 第三章", None), ("第三集" + "长" * 20, None), ("  第 3 部", "部"), ("", None), (None, None)],
)
def test_container_lines(spark, title, unit):
    df = spark.createDataFrame([(title,)], "t string")
    assert df.select(hi.container_unit(df.t)).first()[0] == unit
