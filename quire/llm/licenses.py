"""Licence scans with ordered signature rules, in DataFrame functions only.

Text becomes lower-case words joined by single blanks.  A prefilter intersects the words of a text with the words
of all rules, which leaves most texts alone; in the others every rule that has one of its words is matched (its
regex is a literal, compiled once a task).  Each match is a detection: an interval of words with its rule's label,
priority and weight.  Detections are resolved in order of start, longest first: one that lies within an interval
of equal or higher priority is suppressed.  The four base phrases are counted at all their places and their labels
always stay.

All of it is one projection per row: no shuffle, no join, nothing that groups rows.

Defined results: null or empty text has no words, no labels, score 0; equal intervals of equal priority:
the first rule wins; texts of any length are scanned whole; repeated rows and null ids are scanned like any
others; columns not named in ``keep`` are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quire.llm.license_rules import FAMILIES, GRANT, TAG, signatures

#: phrase -> label
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
_SPAN = "array<struct<first:int,last:int,priority:int,rule:int,label:string,weight:double>>"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal(text: Column) -> Column:
    """Words with A-Z lower-cased, each with one blank before it, and one at the end; a lone blank if there is none."""
    text = F.coalesce(text, F.lit(""))
    # lower() is quicker, and lowers letters beyond A-Z, which no rule has and which stay letters; only the lower
    # case of these two has an ASCII letter
    odd = F.contains(text, F.lit("\u212a")) | F.contains(text, F.lit("\u0130"))
    low = F.when(odd, F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))
    words = F.trim(F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.when(words == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def _words(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def hits(text: Column) -> Column:
    """The words of a normal() text that are words of rules."""
    return F.array_intersect(F.split(text, " "), _words(sorted({w for *_, words, _ in signatures() for w in words} | {p.split()[-1] for p in BASE})))


def _blanks(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def _whole(regex: str) -> str:
    return f"(?<= )(?:{regex})(?= )"


def _marked(text: Column, regex: str) -> Column:
    """The text with its matches of whole words between U+0001 and U+0002, which normal() never leaves."""
    return F.regexp_replace(text, _whole(regex), "\x01$0\x02")


def _places(marked: Column) -> Column:
    """array<struct<first, last, head>>: words (from 0) and text of all marked matches."""
    parts = F.split(marked, "\x01")
    none = F.array().cast("array<struct<first:int,last:int,head:string>>")

    def step(acc, part):
        head = F.substring_index(part, "\x02", 1)
        first = acc["at"] - 1
        place = F.struct(first.cast("int").alias("first"), (first + _blanks(head)).cast("int").alias("last"), head.alias("head"))
        return F.struct((acc["at"] + _blanks(part)).alias("at"), F.concat(acc["out"], F.array(place)).alias("out"))

    start = F.struct(_blanks(parts[0]).alias("at"), none.alias("out"))
    return F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), start, step, lambda acc: acc["out"])


def detections(text: Column, found: Column) -> Column:
    """All matches of all rules that have a word in ``found``, unresolved; text is normal()."""
    rules = signatures()
    names = sum(len(r) for _, r in FAMILIES)
    gated: dict[tuple[str, ...], Column] = {words: F.arrays_overlap(found, _words(words)) for *_, words, _ in rules}
    live = [F.struct(F.lit(i).alias("rule"), F.when(gated[words] & F.rlike(text, F.lit(_whole(regex))), _marked(text, regex)).alias("marked")) for i, (*_, words, regex) in enumerate(rules)]
    label, priority, weight = (F.array(*[F.lit(r[k]) for r in rules]) for k in (0, 1, 2))
    grants = [v for v in GRANT[3 : GRANT.index(")")].split("|")]

    def spans(r):
        def one(s):
            name = r["rule"] < names
            tag, grant = name & s["head"].startswith(TAG), name & F.substring_index(s["head"], " ", 1).isin(grants)
            p = F.when(tag, 4).when(grant, 3).otherwise(priority[r["rule"]])
            w = F.when(tag, 1.0).when(grant, 0.9).otherwise(weight[r["rule"]])
            return F.struct(s["first"].alias("first"), s["last"].alias("last"), p.alias("priority"), r["rule"].alias("rule"), label[r["rule"]].alias("label"), w.alias("weight"))

        return F.transform(_places(r["marked"]), one)

    every = F.flatten(F.transform(F.filter(F.array(*live), lambda r: r["marked"].isNotNull()), spans))
    return F.when(F.size(found) > 0, every).otherwise(F.array().cast(_SPAN))


def _ordered(spans: Column) -> Column:
    key = F.transform(spans, lambda s: F.struct(s["first"].alias("a"), (-s["last"]).alias("b"), (-s["priority"]).alias("c"), s["rule"].alias("d"), s.alias("s")))
    return F.transform(F.array_sort(key), lambda k: k["s"])


def resolve(spans: Column) -> Column:
    """struct<labels, weight>: what is left of detections after suppression by containment.

    Going through them by start, longest first, a detection is contained in an earlier one of priority p
    or more exactly if the furthest end among those reaches its own end; four running ends are enough.
    """
    start = F.struct(*[F.lit(-1).alias(f"e{p}") for p in (1, 2, 3, 4)], F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("weight"))

    def step(acc, s):
        reach = F.when(s["priority"] == 1, acc["e1"]).when(s["priority"] == 2, acc["e2"]).when(s["priority"] == 3, acc["e3"]).otherwise(acc["e4"])
        stays = reach < s["last"]
        ends = [F.when(s["priority"] >= p, F.greatest(acc[f"e{p}"], s["last"])).otherwise(acc[f"e{p}"]).alias(f"e{p}") for p in (1, 2, 3, 4)]
        labels = F.when(stays, F.array_union(acc["labels"], F.array(s["label"]))).otherwise(acc["labels"])
        return F.struct(*ends, labels.alias("labels"), F.when(stays, F.greatest(acc["weight"], s["weight"])).otherwise(acc["weight"]).alias("weight"))

    return F.aggregate(_ordered(spans), start, step, lambda acc: F.struct(acc["labels"].alias("labels"), acc["weight"].alias("weight")))


def scan(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, n_words, base (places of the base phrases), detections, labels, base_labels, score."""
    names = [f"k{i}" for i in range(len(keep))]
    t = df.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], normal(F.col(text_col)).alias("t"))
    t = t.withColumn("found", hits(F.col("t")))
    base = [F.when(F.array_contains("found", p.split()[-1]) & F.contains("t", F.lit(f" {p} ")), _places(_marked(F.col("t"), p))).otherwise(F.array().cast("array<struct<first:int,last:int,head:string>>")) for p in BASE]
    t = t.select(*names, (_blanks(F.col("t")) - 1).cast("long").alias("n_words"), F.array(*base).alias("by"), detections(F.col("t"), F.col("found")).alias("detections"))
    t = t.withColumn("resolved", F.when(F.size("detections") > 0, resolve(F.col("detections"))))
    flat = F.transform(F.flatten("by"), lambda s: s["first"])
    found = F.array_sort(F.filter(F.array(*[F.when(F.size(F.col("by")[i]) > 0, F.lit(label)) for i, label in enumerate(BASE.values())]), lambda x: x.isNotNull()))
    t = t.select(*names, "n_words", F.array_sort(flat).alias("base"), "detections", found.alias("base_labels"), F.coalesce("resolved.labels", F.array().cast("array<string>")).alias("own"), F.coalesce("resolved.weight", F.lit(0.0)).alias("weight"))
    score = F.when(F.size("base_labels") > 0, F.greatest("weight", F.lit(0.7))).otherwise(F.col("weight"))
    return t.select(*[F.col(n).alias(c) for n, c in zip(names, keep)], "n_words", "base", "detections", "base_labels", F.array_sort(F.array_union("base_labels", "own")).alias("labels"), score.alias("score"))
