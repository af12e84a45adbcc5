import json
import zipfile

from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators import runs
from quire.operators.titles import order_rules
from quire.plans import convert
from quire.sources import epub, files, sinks
from quire.streaming.watch import watch_documents

NOVEL = "开头行\n" + "".join(f"第{n}章 标题\n内容，甲。\n\n乙 <b>&\n" for n in "一二三")


def test_convert_files(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_bytes(NOVEL.encode())
    (tmp_path / "in" / "sub" / "a.TXT").write_bytes(NOVEL.replace("\n", "\r\n").encode("gb18030"))
    (tmp_path / "in" / "empty.txt").write_bytes(b"")
    (tmp_path / "in" / "no.md").write_bytes(b"x")
    root = str(tmp_path / "in")
    found = files.scan_files(spark, [root, root, str(tmp_path / "gone")])
    assert found.count() == 3
    assert files.scan_files(spark, [root], recursive=False).count() == 2
    got = {r.path.rsplit("/", 2)[-1] if "sub" not in r.path else "sub": r for r in convert.convert(spark, [root], "out").collect()}
    assert all(r.success for r in got.values()) and len(got) == 3
    assert got["a.txt"].chapter_count == got["sub"].chapter_count == 4 and got["empty.txt"].chapter_count == 1
    assert sorted(r.out_path for r in got.values()) == ["out/a.epub", "out/a_1.epub", "out/empty.epub"]
    path = tmp_path / "x.epub"
    path.write_bytes(got["a.txt"].epub)
    with zipfile.ZipFile(path) as z:
        assert z.namelist()[0] == "mimetype"
        page = z.read("EPUB/chap_002.xhtml").decode()
    assert "<p>乙 &lt;b&gt;&amp;</p>" in page and page.count("<p>") == 2
    two = convert.convert(spark, [root], "out", max_chapters=2).where("path like '%/in/a.txt'").collect()
    assert sorted((r.volume, r.chapter_count) for r in two) == [(1, 2), (2, 2)]
    _, split = convert.chapters_of_files(spark, [root], split_lines=2)
    _, whole = convert.chapters_of_files(spark, [root])
    assert split.exceptAll(whole).isEmpty() and whole.exceptAll(split).isEmpty()
    m = {r.source.rsplit("/", 1)[-1]: r for r in files.ingest(found).collect()}
    assert m["a.TXT"].encoding == "gb18030" and m["empty.txt"].id == "01"


def test_block_reader_handles_line_ends_at_block_edges(spark, tmp_path):
    raw = "ab\r\ncd\re\n\nf".encode()
    df = spark.createDataFrame([(1, raw, "utf-8")], "book_id long, content binary, encoding string")
    want = [("ab", True), ("cd", True), ("e", True), ("", True), ("f", False)]
    for block in range(1, 13):
        got = [(r.line, r.ended) for r in files.file_lines(df, block).orderBy("line_no").collect()]
        assert got == want, block


def test_rules_and_logs(spark, tmp_path):
    rules = [{"enable": True, "id": 1, "name": "晋江", "rule": "a", "serialNumber": -1}, {"enable": False, "id": 2, "name": "x", "rule": "b", "serialNumber": 5}, {"enable": True, "id": 3, "name": "目录", "rule": "c", "serialNumber": 1}, {"enable": True, "id": 4, "name": "none", "rule": "", "serialNumber": 0}]
    (tmp_path / "r.json").write_text(json.dumps(rules, ensure_ascii=False, indent=1))
    got = [r.name for r in order_rules(files.read_rules(spark, str(tmp_path / "r.json"))).collect()]
    assert got == ["目录", "x", "晋江"]
    (tmp_path / "l.jsonl").write_text('{"run_id":"a","ok":true,"wall_s":1.5}\n\nnot json\n{"run_id":"b","ok":false,"error":"e"}\n')
    log = files.read_run_log(spark, [str(tmp_path / "l.jsonl"), str(tmp_path / "missing")])
    assert sorted(r.run_id for r in log.collect()) == ["a", "b"]
    assert [r.run_id for r in runs.measured(log).collect()] == ["a"]
    assert files.read_run_log(spark, [str(tmp_path / "missing")]).count() == 0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a|")], "k int, v string")
    sinks.write_csv(df, str(tmp_path / "c"), ["k", "v"], ["k"])
    raw = next((tmp_path / "c").glob("part-*")).read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfk,v\n1,") or raw.startswith(b'"\xef\xbb\xbf')
    sinks.append_jsonl(df, str(tmp_path / "j"))
    sinks.append_jsonl(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 4
    assert "| 1 | a\\| |" in sinks.markdown(df, "t") and "1 more rows" in sinks.markdown(df, "t", 1)
    out = sinks.write_books(df.select(F.col("v").cast("binary").alias("epub"), "k"), str(tmp_path / "b"), F.concat(F.col("k").cast("string"), F.lit(".epub"))).collect()
    assert all(r.ok for r in out) and (tmp_path / "b" / "2.epub").read_bytes() == b"b"


def test_epub_validity(spark):
    good = epub.build([("t", "<p>x</p>")], "book", groups=[("t", [0])], cover=b"jpg")
    df = spark.createDataFrame([(good,), (b"nope",), (None,)], "c binary")
    assert [r[0] for r in df.select(epub.is_valid(F.col("c"))).collect()] == [True, False, False]
    assert epub.build([("t", "")], "b") == epub.build([("t", "")], "b")


def test_stream_equals_batch(spark, tmp_path):
    from quire.operators.segment import segment

    df = spark.createDataFrame([(1, NOVEL, "zh", "s", 1), (2, "", "zh", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second start finds nothing new
        q = watch_documents(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"))
        q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    want = segment(df)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_small_expressions(spark):
    df = spark.createDataFrame([("/a/b/c.x.txt", "ab\ncd ef", "cd zz")], "p string, t string, h string")
    r = df.select(tx.stem(F.col("p")).alias("s"), tx.locate(F.col("t"), F.col("h")).alias("l"), tx.paragraphs(F.lit(" a\n\n　b ")).alias("g")).first()
    assert r.s == "c.x" and tuple(r.l) == (4, 2) and r.g == "<p>a</p>\n<p>b</p>"


def test_robust_fit_and_plan(spark):
    pts = spark.createDataFrame([("k", float(x), 2.0 * x + 1) for x in range(8)] + [("few", 1.0, 1.0)], "k string, x double, y double")
    r = runs.robust_fit(pts, "x", "y", ["k"]).collect()
    assert [(q.k, q.a, q.b) for q in r] == [("k", 1.0, 2.0)]
    s = spark.createDataFrame([(f"{i:02d}",) for i in range(1, 7)], "sample_id string")
    assert runs.plan_runs(s, ["v1", "v2", "v3"], "S1", 3).count() == 54


def test_names_are_unique_whatever_the_stems(spark):
    df = spark.createDataFrame([(1, "d", "a"), (2, "d", "a"), (3, "d", "a_1"), (4, "d", "a_1"), (5, "d", "a"), (6, "e", "a"), (7, "d", "a_1_1"), (8, "d", "a_3")], "id int, folder string, stem string")
    got = {r.id: r.out_path for r in runs.unique_paths(df, F.col("folder"), F.col("stem"), ".x", [F.col("id")]).collect()}
    assert len(set(got.values())) == 8 and got[1] == "d/a.x" and got[3] == "d/a_1.x" and got[2] == "d/a_2.x" and got[5] == "d/a_4.x" and got[4] == "d/a_1_2.x"
    held = spark.createDataFrame([("d/a.x",), ("d/a_2.x",), ("d/b.y",)], "path string")
    got = [r.out_path for r in runs.unique_paths(df.where("id < 4"), F.col("folder"), F.col("stem"), ".x", [F.col("id")], held).orderBy("id").collect()]
    assert len(set(got) | {"d/a.x", "d/a_2.x"}) == 5


def test_unknown_encoding_is_a_failed_book(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(NOVEL.encode())
    got = convert.convert(spark, [str(tmp_path)], "out", encoding="no-such-codec").collect()
    assert [(r.success, r.chapter_count) for r in got] == [(False, 0)] and "no-such-codec" in got[0].error
    assert convert.convert(spark, [str(tmp_path)], "out", encoding="gb18030").collect()[0].success


def test_command_line(spark, tmp_path):
    from quire import cli

    novel = "".join(f"第{v}卷 名\n" + "".join(f"第{v * 10 + c}章 题\n文。\n" for c in range(1, 7)) for v in (1, 2))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.txt").write_bytes(novel.encode())
    assert cli.main(["-i", str(tmp_path / "in"), "-o", str(tmp_path / "out"), "-a", "me"], spark) == 0
    with zipfile.ZipFile(tmp_path / "out" / "b.epub") as z:
        assert z.read("EPUB/nav.xhtml").decode().count("<ol>") >= 1
    assert cli.main(["-i", str(tmp_path / "in"), "-o", str(tmp_path / "out"), "--encoding", "nope"], spark) == 1


def test_files_are_read_in_blocks(spark, tmp_path):
    text = "".join(f"行{i}，内容\r\n" if i % 3 else f"line {i}\n" for i in range(900))
    for name in ("utf-8", "gb18030"):
        path = tmp_path / f"{name}.txt"
        path.write_bytes(text.encode(name))
        was = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        try:
            got = files.split_file_lines(spark, str(path), name)
            assert got.select(F.countDistinct("path")).head()[0] == 1
            rows = got.orderBy("line_no").collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", was)
        assert [r.line for r in rows] == text.splitlines() and [r.line_no for r in rows] == list(range(900))


def test_bench_plan_has_126_runs(spark):
    s = spark.createDataFrame([(f"{i:02d}", "gb18030" if i == 4 else "utf-8") for i in range(1, 7)], "sample_id string, encoding string")
    plan = runs.bench_plan(s, ["v1", "v2", "v3"], {"sub": "v2", "pipe": "v3", "serve": "v3"}, "02", ["01", "05"])
    rows = runs.seeded_order(plan, 20260807).orderBy("seq").collect()
    assert len(rows) == 126 == len({r.run_id for r in rows}) and [r.seq for r in rows] == list(range(126)) and [r.warmup for r in rows[:4]] == [True] * 3 + [False]
    assert {r.sample_id for r in rows if r.scene == "batch"} == {"01+02+03+05+06"}


def test_rows_are_numbered_in_ranges(spark):
    df = spark.createDataFrame([(i % 7 if i % 11 else None, i) for i in range(500)], "a int, b int").repartition(5)
    got = runs.numbered(df, "a", [F.col("a"), F.col("b")], parts=5).orderBy("no").collect()
    assert [r.no for r in got] == list(range(1, 501)) and [(r.a is not None, r.a, r.b) for r in got] == sorted([(r.a is not None, r.a, r.b) for r in got], key=lambda x: (x[0], x[1] or 0, x[2]))
    assert runs.numbered(df.where("false"), "a", [F.col("a")]).count() == 0
