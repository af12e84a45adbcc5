"""Registered queries over the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quire.functions import encoding as enc, text as tx
from quire.operators import hierarchy as hi, runs, segment as sg
from quire.operators.titles import order_rules, rule_pattern
from quire.sources import epub


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- SQL parts

_N = "[0-9〇零一二两三四五六七八九十百千万壹贰叁肆伍陆柒捌玖拾佰仟]"
_TAIL = ".{0,40}$"
# RE2 has no look-ahead: X(?!c).{0,40}$ is X(?:[^c\n].{0,39})?$ on one line
_MARK = f"第\\s{{0,4}}{_N}+?\\s{{0,4}}"
TITLE_RE2 = (
    "(?i)^(?:.{0,6}(?:"
    f"(?:[引楔]子|[引序前]言|[序终]章|扉页|[上中下][部篇卷]|卷首语|后记|尾声|番外|={{2,4}}|{_MARK}(?:章|卷|页[、 　])){_TAIL}"
    f"|正文(?:[^完结\\n].{{0,39}})?$|{_MARK}节(?:[^课\\n].{{0,39}})?$|{_MARK}集(?:[^合和\\n].{{0,39}})?$|{_MARK}部(?:[^分是门落\\n].{{0,39}})?$|{_MARK}篇(?:[^张\\n].{{0,39}})?$)"
    f"|.{{0,6}}{_N[:-1]}a-z]{{1,8}}[、. 　].{{0,20}}$)"
)
LINES = """lines AS (
 SELECT doc_id, line_no, line, (al OR line_no < n - 1) AS ended FROM (
  SELECT doc_id, al, len(p) AS n, unnest(range(len(p)))::BIGINT AS line_no, unnest(p) AS line FROM (
   SELECT doc_id, p[-1] = '' AS al, CASE WHEN p[-1] = '' THEN list_slice(p, 1, len(p) - 1) ELSE p END AS p FROM (
    SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text <> ''))))"""
FLAGS = LINES + f""",
f AS (SELECT doc_id, line_no, line, ended,
 length(regexp_replace(line, '^\\s+', '')) > 0 AND length(regexp_replace(line, '^\\s+', '')) + ended::INT < 80
 AND regexp_matches(line, '{TITLE_RE2}') AS is_title FROM lines)"""
GIDS = FLAGS + """,
g AS (SELECT *, sum(is_title::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS gid FROM f)"""
SECTIONS = GIDS + """,
a AS (SELECT doc_id, gid, max(regexp_replace(line, '^\\s+|\\s+$', '', 'g')) FILTER (WHERE is_title) AS title, count(*) FILTER (WHERE NOT is_title) AS nb,
 string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT is_title) AS body FROM g GROUP BY doc_id, gid)"""
CHAPTERS = SECTIONS + """,
m AS (SELECT *, max(nb) OVER (PARTITION BY doc_id) AS mx, max(gid) OVER (PARTITION BY doc_id) AS mg FROM a),
c AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY gid)::INT AS chap_no, coalesce(title, '前言') AS title,
 coalesce(body, '') AS body, nb AS n_lines, length(coalesce(body, ''))::BIGINT AS n_chars
 FROM m WHERE nb > 0 OR (mx = 0 AND gid = mg)),
chapters AS (SELECT * FROM c UNION ALL SELECT doc_id, 1, '前言', '', 0, 0 FROM documents WHERE coalesce(text, '') = '')"""
_INDEX = """idx AS (
 SELECT o_custkey AS book, o_orderkey * 10 AS idx, CASE o_orderstatus WHEN 'F' THEN '【第' || o_orderkey || '卷】' WHEN 'O' THEN '第 ' || (o_orderkey % 100) || ' 部 ' || o_orderpriority ELSE '第' || o_orderkey || '篇 第一集' END AS title FROM orders
 UNION ALL SELECT o_custkey, o_orderkey * 10 + l_linenumber, CASE WHEN l_returnflag = 'R' THEN '第' || l_linenumber || '节 ' || l_shipdate::DATE WHEN l_linenumber = 7 THEN '继续第二卷。' ELSE '第' || l_linenumber || '章' END
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
_NUM = "[0-9零一二三四五六七八九十百千]"
_UNITS = (
    _INDEX
    + f""",
t AS (SELECT *, translate(trim(title), '【】()（）[] 　', '') AS c FROM idx),
u AS (SELECT *, CASE WHEN regexp_matches(c, '^第\\s*{_NUM}+\\s*[卷部篇集]') AND NOT regexp_matches(c, '[章回节完终。，、！？；：（）【】《》〈〉—…·~～"'']|尾声|结束') AND length(c) <= 20
 THEN CASE WHEN regexp_matches(c, '第\\s*{_NUM}+\\s*卷') THEN '卷' WHEN regexp_matches(c, '第\\s*{_NUM}+\\s*部') THEN '部' WHEN regexp_matches(c, '第\\s*{_NUM}+\\s*篇') THEN '篇' ELSE '集' END END AS unit FROM t),
bk AS (SELECT book, count(*) FILTER (WHERE unit IS NULL) AS n_chapters, bool_or(regexp_matches(c, '第\\s*{_NUM}+\\s*[章回]')) AS has_chapter FROM u GROUP BY book),
an AS (SELECT p.book, p.unit, p.n, n_chapters, has_chapter, p.n * 2 <= n_chapters AS accepted FROM (SELECT book, unit, count(*) AS n FROM u WHERE unit IS NOT NULL GROUP BY 1, 2) p JOIN bk USING (book))"""
)
_LOGS = """logs AS (SELECT l_orderkey || '-' || l_linenumber AS run_id, CASE WHEN l_linestatus = 'F' THEN 'S1' ELSE 'S2' END AS scene, l_returnflag AS version,
 l_suppkey::VARCHAR AS sample_id, l_linenumber = 1 AND l_tax > 0.05 AS warmup, l_discount > 0.01 AS ok, CASE WHEN l_quantity > 2 THEN l_extendedprice END AS wall_s, l_quantity AS size_mb, l_discount < 0.08 AS epub_valid, l_shipdate AS ts FROM lineitem),
good AS (SELECT * FROM logs WHERE NOT warmup AND ok)"""

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- lines and chapters


@query(f"WITH {LINES} SELECT doc_id, line_no, line, ended FROM lines")
def lines_explode(spark, d):
    return sg.lines(_t(spark, d, "documents"))


@query(f"WITH {LINES} SELECT doc_id, count(*) AS n_lines FROM lines GROUP BY doc_id")
def lines_per_doc(spark, d):
    return sg.lines(_t(spark, d, "documents")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"))


@query(f"WITH {FLAGS} SELECT doc_id, line_no, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS title FROM f WHERE is_title")
def title_lines(spark, d):
    f = sg.flag_titles(sg.lines(_t(spark, d, "documents")))
    return f.where("is_title").select("doc_id", "line_no", tx.strip(F.col("line")).alias("title"))


@query(f"WITH {CHAPTERS} SELECT * FROM chapters")
def chapter_split(spark, d):
    return sg.segment(_t(spark, d, "documents"))


@query(f"WITH {CHAPTERS} SELECT * FROM chapters")
def two_phase_segment(spark, d):
    f = sg.flag_titles(sg.lines(_t(spark, d, "documents").where("text <> ''")))
    got = sg.chapters_of(sg.sections(sg.number_sections_two_phase(f, size=3)))
    return got.unionByName(sg.segment(_t(spark, d, "documents").where("coalesce(text, '') = ''")))


@query(f"WITH {CHAPTERS} SELECT doc_id, count(*) AS n_chapters, max(n_chars) AS longest, sum(n_lines)::BIGINT AS n_lines, max_by(title, n_chars * 100000 + chap_no) AS longest_title FROM chapters GROUP BY doc_id")
def chapter_stats(spark, d):
    c = sg.segment(_t(spark, d, "documents"))
    return c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chapters"), F.max("n_chars").alias("longest"), F.sum("n_lines").alias("n_lines"), F.max_by("title", F.col("n_chars") * 100000 + F.col("chap_no")).alias("longest_title"))


@query(f"WITH {SECTIONS} SELECT doc_id, gid::BIGINT AS gid, coalesce(title, '前言') AS title FROM a WHERE nb = 0")
def empty_section_drop(spark, d):
    s = sg.sections(sg.number_sections(sg.flag_titles(sg.lines(_t(spark, d, "documents")))))
    return s.where("n_lines = 0").select("doc_id", "gid", F.coalesce("title", F.lit("前言")).alias("title"))


@query(
    f"""WITH {FLAGS}, o AS (SELECT *, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM f),
x AS (SELECT *, max(off + strlen(line) + ended::INT) OVER (PARTITION BY doc_id) AS total FROM o)
SELECT doc_id, row_number() OVER w::INT AS chap_no, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS title, off AS "start", coalesce(lead(off) OVER w, total)::BIGINT AS "end" FROM x WHERE is_title WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)"""
)
def chapter_toc(spark, d):
    return sg.toc(_t(spark, d, "documents"))


@query(f"WITH {LINES} SELECT doc_id, line_no, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM lines")
def byte_offset_index(spark, d):
    return sg.byte_index(sg.lines(_t(spark, d, "documents"))).select("doc_id", "line_no", F.col("offset").alias("off"))


@query("SELECT doc_id, unnest(range(len(p)))::BIGINT AS line_no, unnest(p) AS line FROM (SELECT doc_id, CASE WHEN q[-1] = '' THEN list_slice(q, 1, len(q) - 1) ELSE q END AS p FROM (SELECT doc_id, string_split_regex(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]') AS q FROM documents WHERE text <> ''))")
def unicode_lines(spark, d):
    return sg.lines(_t(spark, d, "documents"), newlines="unicode").drop("ended")


@query("SELECT doc_id, n::INT AS page, CASE WHEN n = 0 THEN substr(text, 1, 800) ELSE substr(text, 801 + (n - 1) * 2000, 2000) END AS part FROM (SELECT doc_id, text, unnest(range(1 + greatest(0, length(text) - 800 + 1999) // 2000)) AS n FROM documents WHERE text IS NOT NULL)")
def preview_pages(spark, d):
    return tx.pages(_t(spark, d, "documents").where("text is not null"), "doc_id", "text")


@query(f"WITH {CHAPTERS} SELECT doc_id, chap_no, strpos(text, title)::INT AS pos, (length(substr(text, 1, strpos(text, title)::INT - 1)) - length(replace(substr(text, 1, strpos(text, title)::INT - 1), chr(10), '')) + 1)::INT AS line_no FROM chapters JOIN documents USING (doc_id) WHERE title <> '前言' AND strpos(text, title) > 0")
def chapter_locate(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "text")
    c = sg.segment(docs).where("title <> '前言'").select("doc_id", "chap_no", "title").join(docs, "doc_id")
    return c.select("doc_id", "chap_no", tx.locate(F.col("text"), F.col("title")).alias("l")).where("l is not null").select("doc_id", "chap_no", F.col("l.pos").alias("pos"), F.col("l.line_no").alias("line_no"))


@query(f"WITH {LINES}, n AS (SELECT doc_id, count(*) AS n FROM lines GROUP BY 1) SELECT doc_id, least(line_no // greatest(1, n // 4), 3)::INT AS part, count(*) AS n_lines FROM lines JOIN n USING (doc_id) GROUP BY 1, 2")
def even_split(spark, d):
    rows = sg.lines(_t(spark, d, "documents"))
    n = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    return rows.withColumn("n", n).select("doc_id", sg.even_part(F.col("line_no"), F.col("n"), 4).alias("part")).groupBy("doc_id", "part").agg(F.count(F.lit(1)).alias("n_lines"))


@query("SELECT doc_id, greatest(1, ceil(n_chars / 1000.0))::INT AS chunks, CASE WHEN n_chars * 1024 < 5 * 1048576 THEN 1 WHEN n_chars * 1024 < 15 * 1048576 THEN 2 WHEN n_chars * 1024 < 200 * 1048576 THEN 4 ELSE 6 END AS by_table FROM documents")
def chunk_plan(spark, d):
    return _t(spark, d, "documents").select("doc_id", sg.chunk_count(F.col("n_chars"), 1000).alias("chunks"), sg.chunk_count_by_table(F.col("n_chars") * 1024).alias("by_table"))


# ---------------------------------------------------------------- rules

_RULES = [(0, "#28", "", -1), (1, "晋江", "^前言$", -1), (2, "目录(去空白)", "^\\S+ 0", 0), (3, "目录", "^[A-Z][a-z]{1,3} ", 1), (4, "数字", "^\\d{1,5}[:,.].{1,30}$", 7), (5, "通用规则", "^.{1,20}$", 24), (6, "顶格标题", "^\\S.{1,20}$", 17), (7, "无号", "\\|", None), (8, "双", "^(\\S+) (\\S+)$", 17)]
_RULE_SQL = "rules(pos, name, rule, \"serialNumber\") AS (VALUES " + ", ".join(f"({p}, '{n}', '{r}', {'NULL' if s is None else s})" for p, n, r, s in _RULES) + ")"


def _rules(spark):
    return spark.createDataFrame(_RULES, "pos int, name string, rule string, serialNumber int")


_RANK = "CASE WHEN name = '目录' THEN -9998 WHEN contains(name, '目录(去空白)') THEN -9997 WHEN name = '通用规则' THEN -9996 WHEN contains(name, '晋江') THEN 9998 ELSE coalesce(\"serialNumber\", 99) END"


@query(f"WITH {_RULE_SQL} SELECT pos, name, {_RANK} AS rank, row_number() OVER (ORDER BY {_RANK}, pos)::INT AS place FROM rules WHERE rule <> ''")
def rule_priority_sort(spark, d):
    r = order_rules(_rules(spark))
    return r.select("pos", "name", "rank", F.row_number().over(Window.orderBy("rank", "pos")).alias("place"))


@query(f"WITH {_RULE_SQL}, {LINES} SELECT pos, count(*) AS n_lines, count(*) FILTER (WHERE regexp_matches(line, rule)) AS n_titles FROM lines, rules WHERE rule <> '' GROUP BY pos")
def rule_match_matrix(spark, d):
    rows = sg.lines(_t(spark, d, "documents"))
    live = [(p, r) for p, _, r, _ in _RULES if r]
    per = [F.struct(F.lit(p).alias("pos"), F.count(F.lit(1)).alias("n_lines"), F.count(F.when(F.col("line").rlike(f"(?d){r}"), 1)).alias("n_titles")) for p, r in live]
    return rows.agg(F.array(*per).alias("a")).select(F.inline("a"))


# ---------------------------------------------------------------- volumes, edits, rendering


@query(f"WITH {CHAPTERS} SELECT doc_id, ((chap_no - 1) // 3 + 1)::INT AS volume, min(chap_no) AS first_chap, max(chap_no) AS last_chap FROM chapters GROUP BY 1, 2")
def volume_ranges(spark, d):
    c = sg.segment(_t(spark, d, "documents"))
    return c.groupBy("doc_id", sg.volume_of(F.col("chap_no"), 3).alias("volume")).agg(F.min("chap_no").alias("first_chap"), F.max("chap_no").alias("last_chap"))


@query(f"WITH {CHAPTERS}, n AS (SELECT *, max(chap_no) OVER (PARTITION BY doc_id) AS mx FROM chapters) SELECT doc_id, title, n_chars, (CASE WHEN mx < 4 THEN chap_no WHEN chap_no = 4 THEN 2 WHEN chap_no IN (2, 3) THEN chap_no + 1 ELSE chap_no END)::INT AS chap_no FROM n")
def chapter_move(spark, d):
    return sg.move(sg.segment(_t(spark, d, "documents")), 4, 2).select("doc_id", "title", "n_chars", "chap_no")


@query(
    f"""WITH {CHAPTERS}, k AS (SELECT *, chap_no = 1 OR NOT (n_chars < 200) AS keep FROM chapters),
e AS (SELECT *, sum(keep::INT) OVER (PARTITION BY doc_id ORDER BY chap_no) AS no FROM k)
SELECT doc_id, no::BIGINT AS chap_no, max(title) FILTER (WHERE keep) AS title, string_agg(body, chr(10) ORDER BY e.chap_no) AS body, sum(n_lines)::BIGINT AS n_lines, length(string_agg(body, chr(10) ORDER BY e.chap_no))::BIGINT AS n_chars FROM e GROUP BY doc_id, no"""
)
def chapter_delete_merge(spark, d):
    return sg.delete_into_previous(sg.segment(_t(spark, d, "documents")), F.col("n_chars") < 200)


@query(
    """WITH p AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\\r\\n|[\\n\\r]'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS l FROM documents WHERE text IS NOT NULL)
SELECT doc_id, array_to_string(list_transform(l, lambda x: '<p>' || replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</p>'), chr(10)) AS html FROM p"""
)
def paragraph_render(spark, d):
    return _t(spark, d, "documents").where("text is not null").select("doc_id", tx.paragraphs(F.col("text")).alias("html"))


@query(f"WITH {CHAPTERS} SELECT doc_id, count(*)::INT AS chapter_count, '' AS error, true AS valid FROM chapters GROUP BY doc_id")
def epub_package(spark, d):
    done = epub.package(sg.segment(_t(spark, d, "documents")), "doc_id")
    return done.select("doc_id", "chapter_count", "error", epub.is_valid(F.col("epub")).alias("valid"))


# ---------------------------------------------------------------- hierarchy


def _index(spark, d):
    o, li = _t(spark, d, "orders"), _t(spark, d, "lineitem")
    s = F.col("o_orderkey").cast("string")
    vol = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("【第"), s, F.lit("卷】"))).when(F.col("o_orderstatus") == "O", F.concat(F.lit("第 "), (F.col("o_orderkey") % 100).cast("string"), F.lit(" 部 "), F.col("o_orderpriority"))).otherwise(F.concat(F.lit("第"), s, F.lit("篇 第一集")))
    n = F.col("l_linenumber").cast("string")
    chap = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("第"), n, F.lit("节 "), F.to_date("l_shipdate").cast("string"))).when(F.col("l_linenumber") == 7, F.lit("继续第二卷。")).otherwise(F.concat(F.lit("第"), n, F.lit("章")))
    a = o.select(F.col("o_custkey").alias("book"), (F.col("o_orderkey") * 10).alias("idx"), vol.alias("title"))
    b = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", F.col("o_orderkey") * 10 + F.col("l_linenumber"), chap)
    return a.union(b)


@query(f"WITH {_INDEX}, t AS (SELECT book, unnest(regexp_extract_all(translate(trim(title), '【】()（）[] 　', ''), '第\\s*{_NUM}+\\s*([卷部篇集章回节])', 1)) AS unit FROM idx) SELECT book, unit, count(*) AS n FROM t GROUP BY 1, 2")
def unit_counts(spark, d):
    return hi.unit_counts(_index(spark, d))


@query(f"WITH {_UNITS} SELECT book, idx, title, unit FROM u WHERE unit IS NOT NULL")
def container_guard(spark, d):
    return _index(spark, d).withColumn("unit", hi.container_unit(F.col("title"))).where("unit is not null")


@query(f"WITH {_UNITS} SELECT book, unit, n, n_chapters, has_chapter, accepted FROM an")
def hierarchy_analyze(spark, d):
    return hi.analyze(_index(spark, d))


@query(
    f"""WITH {_UNITS}, v AS (SELECT u.book, idx, title, an.unit IS NOT NULL AS vol FROM u LEFT JOIN an ON u.book = an.book AND u.unit = an.unit AND accepted WHERE u.book IN (SELECT book FROM an WHERE accepted)),
g AS (SELECT *, sum(vol::INT) OVER (PARTITION BY book ORDER BY idx ROWS UNBOUNDED PRECEDING) AS group_no FROM v)
SELECT book, group_no::BIGINT AS group_no, coalesce(max(title) FILTER (WHERE vol), '正文') AS volume_title, array_to_string(list(idx ORDER BY idx), ',') AS members FROM g GROUP BY book, group_no"""
)
def hierarchy_groups(spark, d):
    return hi.groups(_index(spark, d)).withColumn("members", F.array_join(F.transform("members", lambda x: x.cast("string")), ","))


# ---------------------------------------------------------------- encodings


@query("SELECT doc_id, regexp_matches(text, '[\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{f900}-\\x{faff}\\x{3000}-\\x{303f}\\x{ff00}-\\x{ffef}]') AS cjk, regexp_matches(text || CASE WHEN doc_id % 3 = 0 THEN '，' ELSE '' END, '[\\x{ff00}-\\x{ffef}]') AS marked FROM documents WHERE text IS NOT NULL")
def cjk_flag(spark, d):
    docs = _t(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", enc.has_cjk(F.col("text")).alias("cjk"), enc.has_cjk(F.concat("text", F.when(F.col("doc_id") % 3 == 0, "，").otherwise(""))).alias("marked"))


@query("SELECT doc_id, round((length(text) - length(translate(text, '，。！？、：；“”‘’（）《》【】…—', '')))::DOUBLE / greatest(1, length(text)), 8) AS density, round((length(text) - length(translate(text, '.,|', '')))::DOUBLE / greatest(1, length(text)), 8) AS latin FROM documents WHERE text IS NOT NULL")
def punct_density(spark, d):
    docs = _t(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.round(enc.punct_density(F.col("text")), 8).alias("density"), F.round(enc.punct_density(F.col("text"), ".,|"), 8).alias("latin"))


#: name, bytes, what is found: encoding, confidence, first encoding that decodes all, valid UTF-8, text without malformed bytes.
#: The samples are made of two short Chinese sentences, whatever the codec.
_SAYS = "他说，今天很好，明天也好。你来吗？好，就这样！"
_BYTES = [
    ("utf8", _SAYS.encode(), "utf-8", 1.0, "utf-8", True, _SAYS),
    ("bom", b"\xef\xbb\xbf" + _SAYS.encode(), "utf-8-sig", 1.0, "utf-8", True, _SAYS),
    ("gb18030", _SAYS.encode("gb18030"), "gb18030", 0.9, "gb18030", False, _SAYS),
    ("big5", "他說，今天很好，明天也好。你來嗎？好，就這樣！".encode("big5"), "big5", 0.9, "gb18030", False, "他說，今天很好，明天也好。你來嗎？好，就這樣！"),
    ("gb18030 with a bad tail", _SAYS.encode("gb18030") + b"\xff\xff", "gb18030", 0.9, "unknown", False, _SAYS),
    ("ascii", b"plain text, nothing else", "utf-8", 0.5, "utf-8", True, "plain text, nothing else"),
    ("utf8 cut off", _SAYS.encode()[:-1], "utf-8", 1.0, "gb18030", True, _SAYS[:-1]),
    ("broken utf8", b"abc\xff def", "gb18030", 0.5, "unknown", False, "abc def"),
    ("empty", b"", "gb18030", 0.5, "utf-8", True, ""),
    ("late", b"x" * 9000 + _SAYS.encode("gb18030"), "gb18030", 0.9, "gb18030", False, "x" * 9000 + _SAYS),
]
_FOUND = ", ".join(f"({-i}, '{e}', {c}::DOUBLE, '{strict}')" for i, (_, _, e, c, strict, _, _) in enumerate(_BYTES, 1))
_DECODED = ", ".join(f"({-i}, {clean}, md5(replace('{text.replace('x' * 9000, '@')}', '@', repeat('x', 9000))))" for i, (*_, clean, text) in enumerate(_BYTES, 1))


def _contents(spark, d):
    """Texts of documents as bytes, and the samples with ids below 0."""
    docs = _t(spark, d, "documents").where("text <> ''").select("doc_id", F.col("text").cast("binary").alias("content"))
    return docs.unionByName(spark.createDataFrame([(-i, bytearray(b[1])) for i, b in enumerate(_BYTES, 1)], "doc_id bigint, content binary"))


@query(f"SELECT doc_id, 'utf-8' AS encoding, 0.5::DOUBLE AS confidence, 'utf-8' AS strict FROM documents WHERE text <> '' UNION ALL SELECT * FROM (VALUES {_FOUND}) s")
def detect_encoding(spark, d):
    c = _contents(spark, d)
    return c.select("doc_id", enc.detect(F.col("content")).alias("e"), enc.strict_ladder(F.col("content")).alias("strict")).select("doc_id", "e.encoding", "e.confidence", "strict")


@query(f"SELECT doc_id, true AS clean, md5(text) AS sum FROM documents WHERE text <> '' UNION ALL SELECT * FROM (VALUES {_DECODED}) s")
def decode_round_trip(spark, d):
    c = _contents(spark, d)
    return c.select("doc_id", enc.utf8_clean(F.col("content")).alias("clean"), F.md5(enc.decode(F.col("content"), enc.detect(F.col("content"))["encoding"])).alias("sum"))


# ---------------------------------------------------------------- grouping of files


@query("SELECT lang, count(*) AS n_files, sum(n_chars)::BIGINT AS total_bytes, array_to_string(list(doc_id ORDER BY n_chars DESC, doc_id), ',') AS files FROM documents GROUP BY lang")
def encoding_chains(spark, d):
    c = runs.encoding_chains(_t(spark, d, "documents"), "lang", "n_chars", "doc_id")
    return c.withColumn("files", F.array_join(F.transform("files", lambda x: x.cast("string")), ","))


@query("SELECT lang, count(*) AS n_files, round(sum(n_chars) / 1048576.0, 2)::DOUBLE AS total_mb FROM documents GROUP BY lang")
def chain_summary(spark, d):
    return runs.chain_summary(_t(spark, d, "documents"), "lang", "n_chars")


@query("SELECT doc_id, source || '/' || lang || CASE WHEN n > 1 THEN '_' || (n - 1) ELSE '' END || '.epub' AS out_path FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS n FROM documents)")
def unique_output_paths(spark, d):
    return runs.unique_paths(_t(spark, d, "documents"), F.col("source"), F.col("lang"), ".epub", [F.col("doc_id")]).select("doc_id", "out_path")


@query("SELECT row_number() OVER (ORDER BY n_chars, doc_id)::INT AS no, doc_id, md5(text) AS sum FROM documents")
def manifest_ids(spark, d):
    docs = _t(spark, d, "documents").select("n_chars", "doc_id", F.md5("text").alias("sum"))
    return runs.numbered(docs, "n_chars", [F.col("n_chars"), F.col("doc_id")]).select("no", "doc_id", "sum")


# ---------------------------------------------------------------- run logs


def _logs(spark, d):
    li = _t(spark, d, "lineitem")
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("run_id"), F.when(F.col("l_linestatus") == "F", "S1").otherwise("S2").alias("scene"), F.col("l_returnflag").alias("version"), F.col("l_suppkey").cast("string").alias("sample_id"),
        ((F.col("l_linenumber") == 1) & (F.col("l_tax") > 0.05)).alias("warmup"), (F.col("l_discount") > 0.01).alias("ok"), F.when(F.col("l_quantity") > 2, F.col("l_extendedprice")).alias("wall_s"), F.col("l_quantity").alias("size_mb"), (F.col("l_discount") < 0.08).alias("epub_valid"), F.col("l_shipdate").alias("ts"),
    )


@query(f"WITH {_LOGS} SELECT scene, version, coalesce(sample_id, '-') AS sample_id, count(*) AS n, round(median(wall_s), 4) AS wall_s_median, round(median(size_mb), 4) AS size_mb_median, round(avg(epub_valid::INT), 2) AS epub_valid_ratio FROM good GROUP BY 1, 2, 3")
def median_by_key(spark, d):
    g = runs.measured(_logs(spark, d))
    return runs.medians(g, {"scene": F.col("scene"), "version": F.col("version"), "sample_id": F.coalesce("sample_id", F.lit("-"))}, ["wall_s", "size_mb"], ["epub_valid"])


@query(f"WITH {_LOGS} SELECT scene, version, count(*) AS n, round(median(wall_s), 4) AS wall_s_median FROM good GROUP BY 1, 2")
def overall_median(spark, d):
    return runs.medians(runs.measured(_logs(spark, d)), {"scene": F.col("scene"), "version": F.col("version")}, ["wall_s"])


@query(f"WITH {_LOGS} SELECT CASE WHEN size_mb < 5 THEN '0-5' WHEN size_mb < 20 THEN '5-20' WHEN size_mb < 40 THEN '20-40' ELSE '>40' END AS bucket, count(*) AS n, median(size_mb) AS median_size, round(median(wall_s) FILTER (WHERE version = 'A'), 4) AS median_1, round(median(wall_s) FILTER (WHERE version = 'N'), 4) AS median_2, round(median(wall_s) FILTER (WHERE version = 'R'), 4) AS median_3 FROM good GROUP BY 1")
def size_buckets_pivot(spark, d):
    b = runs.size_buckets(runs.measured(_logs(spark, d)), "size_mb", "version", "wall_s", ["A", "N", "R"], [0, 5, 20, 40])
    return b.select("bucket", "n", "median_size", *[F.round(f"median_{i}", 4).alias(f"median_{i}") for i in (1, 2, 3)])


@query(f"WITH {_LOGS} SELECT version, round(regr_intercept(wall_s, size_mb), 4) AS a, round(regr_slope(wall_s, size_mb), 6) AS b FROM good GROUP BY 1")
def regr_fit(spark, d):
    return runs.fit(runs.measured(_logs(spark, d)), "size_mb", "wall_s", ["version"]).select("version", F.round("a", 4).alias("a"), F.round("b", 6).alias("b"))


_ROBUST = f"""WITH {_LOGS}, r AS (SELECT version, sample_id, size_mb AS x, wall_s AS y, row_number() OVER (PARTITION BY version, sample_id ORDER BY size_mb, wall_s) - 1 AS i, count(*) OVER (PARTITION BY version, sample_id) AS n FROM good WHERE wall_s IS NOT NULL),
q AS (SELECT version, sample_id, median(x) FILTER (WHERE i < n // 4) AS x1, median(y) FILTER (WHERE i < n // 4) AS y1, median(x) FILTER (WHERE i >= 3 * n // 4) AS x2, median(y) FILTER (WHERE i >= 3 * n // 4) AS y2 FROM r WHERE n >= 4 GROUP BY 1, 2),
fits AS (SELECT version, sample_id, y1 - (y2 - y1) / (x2 - x1) * x1 AS a, (y2 - y1) / (x2 - x1) AS b FROM q WHERE x2 <> x1)"""


@query(_ROBUST + " SELECT version, sample_id, round(a, 4) AS a, round(b, 6) AS b FROM fits")
def robust_fit(spark, d):
    f = runs.robust_fit(runs.measured(_logs(spark, d)), "size_mb", "wall_s", ["version", "sample_id"])
    return f.select("version", "sample_id", F.round("a", 4).alias("a"), F.round("b", 6).alias("b"))


@query(_ROBUST + " SELECT p.sample_id, round((q.a - p.a) / nullif(p.b - q.b, 0), 3) AS x FROM fits p JOIN fits q ON p.sample_id = q.sample_id AND p.version = 'A' AND q.version = 'R'")
def line_crossover(spark, d):
    f = runs.robust_fit(runs.measured(_logs(spark, d)), "size_mb", "wall_s", ["version", "sample_id"])
    p, q = (f.where(F.col("version") == v).select("sample_id", F.col("a").alias(f"a{v}"), F.col("b").alias(f"b{v}")) for v in "AR")
    return p.join(q, "sample_id").select("sample_id", F.round(runs.crossover(F.col("aA"), F.col("bA"), F.col("aR"), F.col("bR")), 3).alias("x"))


@query(f"WITH {_LOGS}, p AS (SELECT sample_id, median(wall_s) FILTER (WHERE version = 'A') AS a, median(wall_s) FILTER (WHERE version = 'N') AS n, median(wall_s) FILTER (WHERE version = 'R') AS r FROM good GROUP BY 1) SELECT 'N' AS version, count(*) FILTER (WHERE n < a) AS wins, count(*) FILTER (WHERE n IS NOT NULL AND a IS NOT NULL) AS compared FROM p UNION ALL SELECT 'R', count(*) FILTER (WHERE r < a), count(*) FILTER (WHERE r IS NOT NULL AND a IS NOT NULL) FROM p")
def win_counts(spark, d):
    return runs.wins(runs.measured(_logs(spark, d)), "sample_id", "version", "wall_s", "A", ["N", "R"])


@query("SELECT l_orderkey, count(DISTINCT l_returnflag) = 3 AS complete, count(DISTINCT l_linestatus) = 1 AS agree FROM lineitem GROUP BY 1")
def count_consistency(spark, d):
    return runs.consistency(_t(spark, d, "lineitem"), "l_orderkey", "l_returnflag", "l_linestatus", 3)


@query("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_run_dedup(spark, d):
    return runs.latest(_t(spark, d, "events"), "user_id", [F.desc("ts"), F.desc("event_id")]).select("event_id", "user_id", "event_type")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def resume_anti_join(spark, d):
    done = _t(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return runs.resume(_t(spark, d, "orders").select("o_orderkey", "o_orderstatus"), done, "o_orderkey")


@query("WITH s AS (SELECT s_suppkey::VARCHAR AS sample_id FROM supplier), g AS (SELECT v AS version, r AS repeat FROM (SELECT unnest(['v1', 'v2', 'v3']) AS v), (SELECT unnest([1, 2, 3]) AS r)) SELECT 'S1-' || version || '-' || sample_id || '-' || repeat AS run_id, 'S1' AS scene, version, sample_id, repeat FROM s, g")
def plan_cross_join(spark, d):
    s = _t(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("sample_id"))
    return runs.plan_runs(s, ["v1", "v2", "v3"], "S1", 3)


@query("WITH s AS (SELECT s_suppkey::VARCHAR AS run_id, s_nationkey = 3 AS warmup FROM supplier) SELECT run_id, warmup, row_number() OVER (ORDER BY NOT warmup, md5('20260807:' || run_id))::INT - 1 AS seq FROM s")
def seeded_shuffle(spark, d):
    s = _t(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("run_id"), (F.col("s_nationkey") == 3).alias("warmup"))
    return runs.seeded_order(s, 20260807)


@query(
    """WITH a AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS p, l_returnflag AS v FROM lineitem WHERE l_quantity > 5), b AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS p, l_returnflag AS v FROM lineitem WHERE l_discount > 0.01)
SELECT coalesce(a.k, b.k) AS k, count(a.v) AS len_a, count(b.v) AS len_b, count(*) FILTER (WHERE a.v <> b.v) AS mismatches, count(a.v) <> count(b.v) AS lengths_differ FROM a FULL JOIN b ON a.k = b.k AND a.p = b.p GROUP BY 1"""
)
def sequence_diff(spark, d):
    li = _t(spark, d, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    a, b = (li.where(c).select(F.col("l_orderkey").alias("k"), F.row_number().over(w).alias("p"), F.col("l_returnflag").alias("v")) for c in ("l_quantity > 5", "l_discount > 0.01"))
    return runs.sequence_diff(a, b, "k", "p", "v")


@query(f"WITH {CHAPTERS}, t AS (SELECT c.title, d.lang FROM chapters c JOIN documents d USING (doc_id)) SELECT title FROM t WHERE lang = 'en' EXCEPT SELECT title FROM t WHERE lang <> 'en'")
def title_except(spark, d):
    docs = _t(spark, d, "documents")
    t = sg.segment(docs).select("doc_id", "title").join(docs.select("doc_id", "lang"), "doc_id")
    return runs.only_in(t.where("lang = 'en'").select("title"), t.where("lang <> 'en'").select("title"))


@query("SELECT l.doc_id, quality, toxic, lang, n_chars FROM labels l JOIN documents d ON l.doc_id = d.doc_id")
def manifest_join(spark, d):
    return _t(spark, d, "labels").select("doc_id", "quality", "toxic").join(_t(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")


@query("SELECT d.doc_id, coalesce(l.quality, -1)::INT AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def lookup_default(spark, d):
    return _t(spark, d, "documents").select("doc_id").join(_t(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"))


@query("SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS success, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN '' ELSE 'no result' END AS error FROM documents")
def reconcile_failures(spark, d):
    return runs.reconcile(_t(spark, d, "documents"), _t(spark, d, "labels"), "doc_id")


@query("SELECT l_orderkey FROM lineitem WHERE l_quantity > 3 GROUP BY 1 HAVING count(DISTINCT l_linenumber) = max(l_linenumber)")
def completed_files(spark, d):
    li = _t(spark, d, "lineitem").where("l_quantity > 3").select("l_orderkey", F.col("l_linenumber").alias("chunk_index"), F.col("l_linenumber").alias("total"))
    return runs.completed(li, "l_orderkey", "total")


@query("SELECT conv_id, array_to_string(list(text ORDER BY turn)[1:5], chr(10)) AS first_texts, count(*) AS turns, count(DISTINCT role) AS roles FROM conversations GROUP BY 1")
def first_titles(spark, d):
    c = _t(spark, d, "conversations")
    return runs.first_of(c, "conv_id", "turn", "text", 5, [F.count(F.lit(1)).alias("turns"), F.countDistinct("role").alias("roles")]).select("conv_id", F.array_join("texts", "\n").alias("first_texts"), "turns", "roles")


@query("SELECT user_id, max(value) AS peak, count(DISTINCT event_type) AS kinds, count(*) FILTER (WHERE event_type = 'purchase') AS ok FROM events GROUP BY 1")
def peak_usage(spark, d):
    return _t(spark, d, "events").groupBy("user_id").agg(F.max("value").alias("peak"), F.countDistinct("event_type").alias("kinds"), F.count(F.when(F.col("event_type") == "purchase", 1)).alias("ok"))


# ---------------------------------------------------------------- more of the same operators


@query(f"WITH {LINES} SELECT doc_id, line_no, line FROM lines WHERE line_no >= 2 AND line_no < 5")
def line_range(spark, d):
    return sg.line_range(sg.lines(_t(spark, d, "documents")), 2, 5).select("doc_id", "line_no", "line")


_PLAIN_TITLE = "^[A-Z][a-z]{1,3} "


@query(f"WITH {CHAPTERS} SELECT * FROM chapters".replace(TITLE_RE2, _PLAIN_TITLE))
def rule_segment(spark, d):
    """The rule table chooses the pattern by name."""
    return sg.segment(_t(spark, d, "documents"), pattern=rule_pattern(_rules(spark), "目录"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'utf-8' ELSE 'gb18030' END AS encoding FROM documents WHERE text <> ''")
def profile_encoding(spark, d):
    docs = _t(spark, d, "documents").where("text <> ''")
    c = F.when(F.col("doc_id") % 2 == 0, F.col("text").cast("binary")).otherwise(F.concat(F.unhex(F.lit("CED2")), F.col("text").cast("binary")))
    return docs.select("doc_id", enc.profile(c).alias("encoding"))


@query(f"WITH {_LOGS} SELECT run_id, scene, warmup FROM logs WHERE scene = 'S2' OR warmup")
def scene_filter(spark, d):
    return runs.in_scenes(_logs(spark, d), ["S2"]).select("run_id", "scene", "warmup")


@query(f"WITH {LINES}, x AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) || CASE WHEN bool_and(ended) THEN chr(10) ELSE '' END AS t FROM lines GROUP BY doc_id) SELECT doc_id, md5(t) AS sum, strlen(t)::BIGINT AS n_bytes FROM x")
def read_chapter_bytes(spark, d):
    """The byte ranges of all chapters, read from the text, and what stands before the first, give the text again."""
    docs = _t(spark, d, "documents").where("text <> ''").select("doc_id", "text")
    ranges = sg.toc(docs).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("r"))
    raw, lead = F.col("text").cast("binary"), F.coalesce(F.get("r", F.lit(0))["start"], F.octet_length("text").cast("long"))
    parts = F.transform(F.coalesce("r", F.array().cast("array<struct<start:bigint,end:bigint>>")), lambda x: sg.read_range(raw, x["start"].cast("int"), x["end"].cast("int")))
    whole = F.concat(sg.read_range(raw, F.lit(0), lead.cast("int")), F.array_join(parts, ""))
    return docs.join(ranges, "doc_id", "left").select("doc_id", F.md5(whole).alias("sum"), F.octet_length(whole).cast("long").alias("n_bytes"))


@query(f"WITH {_INDEX}, t AS (SELECT book, unnest(regexp_extract_all(translate(trim(title), '【】()（）[] 　', ''), '第\\s*{_NUM}+\\s*([卷部篇集章回节])', 1)) AS unit FROM idx) SELECT book, min_by(unit, strpos('卷部篇集章', unit)) AS unit FROM t WHERE strpos('卷部篇集章', unit) > 0 GROUP BY book")
def fixed_priority_unit(spark, d):
    return hi.fixed_priority_unit(_index(spark, d))


_SAMPLES = "s AS (SELECT printf('%02d', n_nationkey + 1) AS sample_id, CASE WHEN n_nationkey = 3 THEN 'gb18030' ELSE 'utf-8' END AS encoding FROM nation WHERE n_nationkey < 6)"


@query(
    f"""WITH {_SAMPLES}, v AS (SELECT unnest(['v1', 'v2', 'v3']) AS version), r AS (SELECT unnest([1, 2, 3])::INT AS repeat), m AS (SELECT unnest(['sub', 'pipe', 'serve']) AS mode)
SELECT 'WARM-' || version || '-02' AS run_id, 'parse' AS scene, version, '02' AS sample_id, 'utf-8' AS encoding, 1 AS repeat, '' AS mode, true AS warmup FROM v
UNION ALL SELECT 'S1-' || version || '-' || sample_id || '-' || repeat, 'parse', version, sample_id, encoding, repeat, '', false FROM s, v, r
UNION ALL SELECT 'S2-' || version || '-' || sample_id || '-' || repeat, 'full', version, sample_id, encoding, repeat, '', false FROM s, v, r
UNION ALL SELECT 'S3-' || mode || '-' || repeat, 'batch', CASE WHEN mode = 'sub' THEN 'v2' ELSE 'v3' END, (SELECT string_agg(sample_id, '+' ORDER BY sample_id) FROM s WHERE encoding = 'utf-8'), 'utf-8', repeat, mode, false FROM m, r
UNION ALL SELECT 'A1-v3-' || sample_id || '-' || repeat, 'detect', 'v3', sample_id, encoding, repeat, '', false FROM s, r WHERE sample_id IN ('01', '05')"""
)
def bench_plan(spark, d):
    n = _t(spark, d, "nation").where("n_nationkey < 6")
    samples = n.select(F.format_string("%02d", F.col("n_nationkey") + 1).alias("sample_id"), F.when(F.col("n_nationkey") == 3, "gb18030").otherwise("utf-8").alias("encoding"))
    return runs.bench_plan(samples, ["v1", "v2", "v3"], {"sub": "v2", "pipe": "v3", "serve": "v3"}, "02", ["01", "05"])


@query("SELECT DISTINCT source || '/' || lang AS path FROM documents")
def distinct_paths(spark, d):
    return _t(spark, d, "documents").select(F.concat_ws("/", "source", "lang").alias("path")).dropDuplicates(["path"])


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10")
def largest_files(spark, d):
    """A report of ten rows."""
    return _t(spark, d, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(10)


@query(f"WITH {CHAPTERS}, v AS (SELECT doc_id || '/' || ((chap_no - 1) // 2 + 1) AS book FROM chapters) SELECT book, count(*)::INT AS chapter_count, true AS valid FROM v GROUP BY book")
def volume_package(spark, d):
    c = sg.segment(_t(spark, d, "documents"))
    parts = c.withColumn("book", F.concat_ws("/", F.col("doc_id").cast("string"), sg.volume_of(F.col("chap_no"), 2).cast("string")))
    return epub.package(parts, "book").select("book", "chapter_count", epub.is_valid(F.col("epub")).alias("valid"))


@query(f"WITH {CHAPTERS}, n AS (SELECT doc_id, count(*) AS n FROM chapters GROUP BY 1), r AS (SELECT d.doc_id, d.doc_id IN (SELECT doc_id FROM labels) AS ok, n FROM documents d JOIN n USING (doc_id)) SELECT count(*) AS books, count(*) FILTER (WHERE ok) AS ok, count(*) FILTER (WHERE NOT ok) AS failed, coalesce(sum(n) FILTER (WHERE ok), 0)::BIGINT AS chapters, round(100.0::DOUBLE * count(*) FILTER (WHERE ok) / count(*), 2) AS percent FROM r")
def batch_totals(spark, d):
    docs = _t(spark, d, "documents")
    n = sg.segment(docs).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    done = runs.reconcile(docs, _t(spark, d, "labels"), "doc_id")
    return runs.totals(done.join(n, "doc_id"), "success", "n")


def entry(spark: SparkSession, sf_dir: str = "/root/testdata/sf0.001") -> DataFrame:
    return chapter_split(spark, sf_dir)
