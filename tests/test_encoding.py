import pytest
from pyspark.sql import functions as F

from quire.functions import encoding as enc

ZH = "夜深了，雨还在下。“你来了？”他说：《书》……" * 40


@pytest.mark.parametrize(
    "raw, name",
    [
        (ZH.encode() + b"\xff" * 200, "utf-8"),
        (ZH.encode("gb18030") + b"\x00" * 50, "gb18030"),
        (b"\xef\xbb\xbf" + ZH.encode(), "utf-8-sig"),
        (b"plain ascii", "utf-8"),
        ("夜深了，雨還在下。「你來了？」他說：《書》" .encode("big5") * 40, "big5"),
        (b"Title page\n" * 5 + ZH.encode("gb18030"), "gb18030"),
        (ZH.encode()[:-1], "utf-8"),
        (b"", "utf-8"),
    ],
)
def test_detect_bytes(raw, name):
    assert enc.detect_bytes(raw)[0] == name


def test_staged_reads_on_while_undecided(spark):
    raw = b"a" * 9000 + ZH.encode("gb18030")
    df = spark.createDataFrame([(raw,), (b"",), (None,)], "c binary")
    got = [tuple(r.e) for r in df.select(enc.detect(F.col("c")).alias("e")).collect()]
    assert got == [("gb18030", 0.9), ("gb18030", 0.5), ("gb18030", 0.5)]
    assert enc.detect_staged(raw, 4)[0] == "utf-8"


def test_clean_and_decode(spark):
    rows = [(ZH.encode(),), (ZH.encode()[:-1],), (ZH.encode()[:-2],), (b"\xff" + ZH.encode(),), (b"abc",), (b"",)]
    df = spark.createDataFrame(rows, "c binary")
    assert [r[0] for r in df.select(enc.utf8_clean(F.col("c"))).collect()] == [True, True, True, False, True, True]
    got = [r[0] for r in df.select(enc.decode(F.col("c"), F.lit("utf-8"))).collect()]
    assert got == [r[0].decode("utf-8", "ignore") for r in rows]


def test_density_and_cjk(spark):
    df = spark.createDataFrame([("，。ab",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(enc.punct_density(F.col("t"))).collect()] == [0.5, 0.0, None]
    assert [r[0] for r in df.select(enc.has_cjk(F.col("t"))).collect()] == [True, False, False]
