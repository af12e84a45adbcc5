"""Encoders, language ID, fingerprints and licence scans against plain versions, with odd rows in every table."""

import hashlib
import itertools
import math
import os
import random
import re
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from quire.llm import bpe, chunks, digest, langid, license_rules, licenses, packing, packing_rounds, token_counts  # noqa: E402

#: null, empty, blank, repeated rows, odd characters, a long text
TEXTS = [None, "", "   \n\t", "a", "A b c", "A b c", "the mit license\n\n x", "né ½² 中文 \x1c\x85 end", "don't  stop <|endoftext|> İ́", "word " * 5000, "x" * 3000]
LETTERS = "ab'sS \n\t\x1c\x1d\x85\xa0 　é½²1٣中文😀.,!<|>ÉİẞΣσ́¨ªº"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    rows = [(None if i == 4 else i, t, None if i % 5 == 0 else ("en" if i % 2 else "fr"), "s", 7, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens long, ids string")


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.Encoder(ranks, public_tokenizers.PATTERN), tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken_and_round_trips(docs, reference):
    enc, tk = reference
    ids = bpe.encode(docs, enc, keep=("doc_id", "text"))
    for r in ids.collect():
        want = tk.encode_ordinary(r.text or "")
        assert bytes(r.ids) == struct.pack(f"<{len(want)}I", *want), r.text
    for r in bpe.decode(ids, enc, keep=("text",)).collect():
        assert bytes(r.decoded) == (r.text or "").encode()
    assert bpe.encode(docs.where("false"), enc).count() == 0


def test_other_patterns_are_not_cut(docs, reference):
    import tiktoken

    other = r"\p{Lu}?\p{Ll}+|\p{Lu}+|\p{N}{1,3}|[^\s\p{L}\p{N}]+[\r\n]*|\s+"
    ranks = reference[0].ranks
    enc, tk = bpe.Encoder(ranks, other), tiktoken.Encoding("o", pat_str=other, mergeable_ranks=ranks, special_tokens={})
    texts = [r.text for r in docs.select("text").collect()] + ["aB cD.\n x", "12345 FOOBar \n\n!"]
    for t in texts:
        want = tk.encode_ordinary(t or "")
        assert enc.encode(t) == struct.pack(f"<{len(want)}I", *want), t
    assert enc.cuts is False and reference[0].cuts and chunks.PATTERN == public_tokenizers.PATTERN
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    got = token_counts.count_tokens(docs, path, other, keep={"text": F.col("text")}).collect()
    assert all(r.n_tokens == len(tk.encode_ordinary(r.text or "")) for r in got)


def test_perfect_hash_is_minimal(reference):
    h = reference[0].whole
    assert all(h.get(k) == r for k, r in reference[0].ranks.items())
    assert sorted(h.ids) == sorted(reference[0].ranks.values()) and len(h.keys) == len(reference[0].ranks)
    assert h.get(b"no such token at all") == -1


def test_cache_may_be_tiny(reference, monkeypatch):
    c = chunks.Cache(len, 4)
    assert [c[w] for w in ("a", "bb", "ccc", "a", "dddd", "a", "bb")] == [1, 2, 3, 1, 4, 1, 2] and len(c) <= 2


def test_token_histogram(docs):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    tk = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    n = sorted(len(tk.encode_ordinary(r.text or "")) for r in docs.select("text").collect())
    answers = token_counts.limits(token_counts.histogram(token_counts.count_tokens(docs, path, public_tokenizers.PATTERN)))
    for r in answers.collect():
        L = r.n_tokens
        assert r.n_docs == n.count(L) and r.docs_ge == sum(x >= L for x in n) and r.tokens_ge == sum(x for x in n if x >= L)
        assert r.truncated_tokens == sum(min(x, L) for x in n) and r.lost_tokens == sum(n) - r.truncated_tokens
        assert r.docs_share == sum(x <= L for x in n) / len(n) and r.tokens_all == sum(n)
    assert token_counts.quantile(answers, 0.5).first()[0] == n[(len(n) + 1) // 2 - 1]
    for limit in (0, 1, 10, 33, 10**6):
        assert token_counts.truncated_total(answers, limit).first()[0] == sum(min(x, limit) for x in n)
    assert token_counts.limits(token_counts.histogram(token_counts.count_tokens(docs.where("false"), path, public_tokenizers.PATTERN))).count() == 0


@pytest.mark.parametrize("pack", [packing.pack, packing_rounds.pack])
def test_packing(docs, pack):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tk = Tokenizer.from_file(path)
    got = pack(docs.withColumn("row", F.monotonically_increasing_id()), path, keep=("row", "text"), shard_tokens=3000, window=256).collect()
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault(r.row, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert len(pieces) == docs.count()
    for p in pieces.values():
        p.sort(key=lambda r: r.start)
        want = tk.encode(p[0].text or "", add_special_tokens=False).ids + [2]
        assert [r.start for r in p] == list(np.cumsum([0] + [r.length for r in p[:-1]])) and p[0].doc_tokens == len(want)
        assert np.frombuffer(b"".join(bytes(r.ids) for r in p), "<u4").tolist() == want, p[0].text
    for s in sequences.values():
        s.sort(key=lambda r: r.offset)
        n = sum(r.length for r in s)
        assert [r.offset for r in s] == list(np.cumsum([0] + [r.length for r in s[:-1]])) and n <= 256 and n & (n - 1) == 0
    assert pack(docs.where("false"), path).count() == 0


def test_neighbours_follow_their_seed():
    a, b = np.arange(10, 40), np.arange(100, 130)
    own = [np.append(x, 2) for x in (a, b, a + 1, b + 1, a + 2, b + 2)]
    order = [p[0] for p in packing.fill(own, packing.ShardIndex(own, np.ones(300), 31.0), 62)]
    assert order[:2] == [0, 2] and order[2] == 1 and order[3] == 3


@pytest.mark.parametrize("pack", [packing.pack, packing_rounds.pack])
def test_neighbours_come_from_all_shards(spark, pack):
    rng = random.Random(21)
    topics = [[rng.choice("bcdfg") + "".join(rng.choice("aeioumnr") for _ in range(7)) for _ in range(40)] for _ in range(60)]
    rows = [(k, " ".join(rng.choice(topics[k]) for _ in range(20))) for _ in range(4) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    path = public_tokenizers.path("word_bpe_49k.json")

    by = {}
    for r in pack(df, path, window=256, shard_tokens=1000).collect():
        by.setdefault(r.sequence_id, []).append(r)
    assert sum(r.length for p in by.values() for r in p) == packing.encode(df, path, 2, "text", ("doc_id",)).agg(F.sum("n")).first()[0]
    full = [p for p in by.values() if sum(r.length for r in p) == 256]
    # shards with their own candidates had 0.96 topics a piece
    assert np.mean([len({r.doc_id for r in p}) / len(p) for p in full]) < 0.8


def test_shards_take_bins_in_order_and_split_large_ones():
    got = packing.deal([(7, 25), (1, 4), (2, 6), (3, 1), (9, 10)], 10)
    assert got == [(1, 0, 1), (2, 0, 1), (3, 1, 1), (7, 2, 3), (9, 5, 1)]
    assert packing.deal([], 10) == []


def test_scores_are_bm25_by_brute_force():
    rng = np.random.default_rng(4)
    own = [rng.integers(0, 60, rng.integers(1, 90)).astype(np.uint16) for _ in range(40)]
    df = np.array([sum(t in d for d in own) for t in range(60)])
    idf, mean = packing._idf(len(own), df), np.mean([len(d) for d in own])
    index = packing.ShardIndex(own, idf, mean)
    for q in range(len(own)):
        want = [sum(np.log(1 + (40 - df[t] + 0.5) / (df[t] + 0.5)) * (tf := (d == t).sum()) * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean)) for t in set(own[q].tolist())) for d in own]
        assert np.allclose(index.scores(q), want)


def test_copies_share_a_shard(spark):
    rng = random.Random(8)
    rows = [" ".join("".join(rng.choice("abcdeiou") for _ in range(5)) for _ in range(30)) for _ in range(150)] * 2
    path = public_tokenizers.path("word_bpe_49k.json")
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(6)
    by = {}
    for r in packing.pack(df, path, window=256, shard_tokens=1500).collect():
        by.setdefault(r.doc_id % 150, set()).add(r.sequence_id >> 32)
    assert np.mean([len(s) == 1 for s in by.values()]) > 0.95


def test_merges_equal_the_tokenizer():
    path = public_tokenizers.path("word_bpe_49k.json")
    enc = packing.WordEncoder(path)
    rng = random.Random(12)
    texts = [" ".join("".join(rng.choice("etaoinshéüñABC'.,1") for _ in range(rng.randint(1, 20))) for _ in range(300)) for _ in range(20)]
    for t, got in zip(texts, [x for own in enc.encode(pa.array(texts), 2) for x in own]):
        assert got.tolist() == enc.whole.encode(t, add_special_tokens=False).ids + [2]


def test_packing_loses_no_document(spark):
    df = spark.range(7001).selectExpr("id AS doc_id", "concat('word ', id, ' and ', id % 13) AS text").coalesce(1)
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack(df, path).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert sorted(r.doc_id for r in got) == list(range(7001)) and all(r.n == r.m for r in got)


def test_long_texts_are_cut_at_white_space(monkeypatch):
    enc = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = [None, "", "one two\tthree " * 50, "x" * 400, " ", "a b"]
    want = [x.tolist() for own in enc.encode(pa.array(texts), 2) for x in own]
    monkeypatch.setattr(packing, "BLOCK", 40)
    assert [x.tolist() for own in enc.encode(pa.array(texts), 2) for x in own] == want and len(want) == 6


def test_language(spark, docs):
    rng = random.Random(5)
    words = {"en": "the of and with that which from were they have".split(), "fr": "les des une dans que pour sur est avec nous".split()}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(30)), lang) for i in range(200) for lang in words]
    table = spark.createDataFrame([(k, t, lang) for k, (_, t, lang) in enumerate(rows)], "doc_id long, text string, lang string")
    model = langid.fit(table.where(~langid.held_out(F.col("doc_id"))))
    held = table.where(langid.held_out(F.col("doc_id")))
    got = langid.identify(held, model, keep={"lang": F.col("lang")}).collect()
    assert len(got) > 50 and all(r.lang == r.lang_pred and 0.5 < r.score <= 1 for r in got)
    odd = langid.identify(docs, model, keep={"text": F.col("text")}).collect()
    assert len(odd) == docs.count()
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) and 0 <= r.score <= 1 for r in odd)
    none = langid.fit(table.where("false"))
    assert {(r.lang_pred, r.score) for r in langid.identify(docs, none).collect()} == {("und", 0.0)}


def plain_bayes(train, texts, bits=16, alpha=0.1, temper=32):
    """Naive Bayes letter by letter: (language, score) of each text."""

    def grams(text):
        cp = [ord(c.lower()[0]) if c.isalpha() else 0 for c in text or ""] + [0, 0]
        for n in (1, 2, 3):
            for i in range(len(cp) - 2):
                if any(cp[i : i + n]):
                    h = n
                    for c, salt in zip(cp[i : i + n], langid.SALTS):
                        h = (h ^ c) * salt & 0xFFFFFFFF
                        h ^= h >> 15
                    yield h >> 32 - bits

    docs, counts = {}, {}
    for text, lang in train:
        if text is not None and lang is not None:
            docs[lang] = docs.get(lang, 0) + 1
            for g in grams(text):
                counts.setdefault(lang, {})[g] = counts.setdefault(lang, {}).get(g, 0) + 1
    langs, out = sorted(docs), []
    total = {k: sum(counts.get(k, {}).values()) + alpha * 2**bits for k in langs}
    for text in texts:
        found = list(grams(text))
        logp = [math.log((docs[k] + 1) / (sum(docs.values()) + len(langs))) + sum(math.log((counts.get(k, {}).get(g, 0) + alpha) / total[k]) for g in found) for k in langs]
        if not any(c.isalpha() for c in text or ""):
            out.append(("und", 0.0))
            continue
        cut = [x * min(len(found), temper) / len(found) for x in logp]
        best = max(range(len(langs)), key=lambda i: logp[i])
        out.append((langs[best], 1 / sum(math.exp(x - cut[best]) for x in cut)))
    return out


def test_language_equals_plain_bayes(spark, docs):
    rng = random.Random(9)
    words = {"en": "the of and with that which Was from they".split(), "fr": "les des été dans que où sur est".split(), "de": "der und für über nicht ÄRGER mit".split()}
    rows = [(i, " ".join(rng.choice(words[g] + words["en"][:3]) for _ in range(rng.randint(1, 12))), g) for i in range(60) for g in words]
    rows = [(k, t, g) for k, (_, t, g) in enumerate(rows)] + [(900, None, "en"), (901, "nur so", None), (902, "123 ...", "de"), (None, "où est", "fr")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = langid.fit(table.where(~langid.held_out(F.col("doc_id"))))
    train = [(r.text, r.lang) for r in table.where(~langid.held_out(F.col("doc_id"))).collect()]
    got = langid.identify(table.select("text").union(docs.select("text").where("length(text) < 200 or text is null")), model, keep={"text": F.col("text")}).collect()
    for r, (lang, score) in zip(got, plain_bayes(train, [r.text for r in got])):
        assert r.lang_pred == lang and abs(r.score - score) < 1e-4, r.text


def test_language_blocks_do_not_change_the_result(monkeypatch):
    text = "".join(random.Random(2).choice("abc é.") for _ in range(4000))
    whole = np.sort(np.concatenate([b for _, _, b in langid._grams([text, None, "ab"], (1, 2, 3), 12)]))
    monkeypatch.setattr(langid, "BLOCK", 64)
    parts = np.sort(np.concatenate([b for _, _, b in langid._grams([text, None, "ab"], (1, 2, 3), 12)]))
    singles = np.sort(np.concatenate([b for _, _, b in langid._grams([text, None, "ab"], (1,), 12)]))
    assert len(whole) == len(parts) and (whole == parts).all() and len(singles) == sum(c.isalpha() for c in text) + 2


def test_fingerprints_and_neighbours(spark):
    rng = random.Random(4)
    texts = [None, "", "é", "short text", "y" * 400] + ["".join(rng.choice("abcde fghij é") for _ in range(rng.randint(50, 3000))) for _ in range(30)]
    texts += [texts[6], texts[6]]
    rows = [(3 * i - 20, t) for i, t in enumerate(texts)]
    got = digest.fingerprints_with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), per_range=4).collect()
    assert sorted(r.doc_id for r in got) == [i for i, _ in rows]
    by = {r.doc_id: r for r in got}
    for k, (i, t) in enumerate(rows):
        t, n = t or "", rows[(k + 1) % len(rows)][1] or ""
        x = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        d, e, f = digest.Document(t), digest.Document(x), digest.Document(n)
        r = by[i]
        assert bytes(r.edited) == x.encode() and r.n_chars == len(t)
        assert (r.fingerprint, r.edited_fingerprint) == (d.chain.text(), e.chain.text())
        assert (r.near_edited, r.near_next) == (d.chain.likeness(e.chain), d.chain.likeness(f.chain))
        assert digest.Chain.parse(r.fingerprint).likeness(d.chain) == 1.0
    one = spark.createDataFrame([(5, "z" * 100)], "doc_id long, text string")
    assert digest.fingerprints_with_next(one).first().near_next == 1.0
    assert digest.fingerprints_with_next(one.where("false")).count() == 0
    dup = spark.createDataFrame([(1, "b"), (1, "a"), (None, "c"), (2, None)], "doc_id long, text string")
    assert digest.fingerprints_with_next(dup).count() == 4


def test_entropy_ranks_by_hand(monkeypatch):
    b = np.frombuffer(bytes(random.Random(1).choices(b"aaabcde  fgh", k=700)), np.uint8)

    def rank(w):
        s = int(digest._F[np.bincount(w, minlength=256)].sum())
        e = (digest._FULL - s) * 1000 // digest._FULL
        return 2000 if e < digest.NOISE else 1000 - abs(e - digest.USUAL)

    want = np.array([rank(b[i : i + 64]) for i in range(len(b) - 63)])
    assert (digest.ranks(b) == want).all()
    whole = digest.select(digest.ranks(b))
    monkeypatch.setattr(digest, "_BLOCK", 100)
    assert (digest.ranks(b) == want).all() and (digest.select(digest.ranks(b)) == whole).all()


def test_licenses_base_counts(spark, docs):
    more = ["CC BY cc-by 4.0 cc by sa", "Apache License, Version 2.0; apache license", "gnu  GENERAL public\nlicense mit license", "mitlicense amit license", "Permission is hereby granted, free of charge, to any person obtaining a copy", "SPDX-License-Identifier: BSD-3-Clause", "cc by cc by"]
    df = docs.select("doc_id", "text").union(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    got = licenses.scan(df, keep=("doc_id", "text")).collect()
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    for r in got:
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (r.text or "").translate(lower))
        at = [(j, label) for p, label in licenses.BASE.items() for j in range(len(words)) if words[j : j + len(p.split())] == p.split()]
        assert r.n_words == len(words) and sorted(r.base) == sorted(j for j, _ in at), r.text
        assert r.base_labels == sorted({x for _, x in at}) and set(r.base_labels) <= set(r.labels) and 0 <= r.score <= 1
    by = {r.doc_id: r.labels for r in got}
    assert by[1001] == ["apache", "apache-2.0"] and by[1004] == ["mit"] and by[1005] == ["bsd-3-clause"] and by[1006] == ["cc-by"]
    assert licenses.scan(docs.where("false")).count() == 0


def _alternatives(parsed):
    """Every text of a parsed regex, with repeats at their least and once more, and the ends of ranges."""
    out = [""]
    for op, of in parsed:
        op = str(op)
        if op == "LITERAL":
            more = [chr(of)]
        elif op == "BRANCH":
            more = [t for b in of[1] for t in _alternatives(b)]
        elif op == "SUBPATTERN":
            more = _alternatives(of[3])
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            own = _alternatives(of[2])
            more = ["".join(c) for k in range(of[0], max(of[0], 1) + 1) for c in itertools.product(own, repeat=k)]
        else:
            assert op == "IN", op
            more = [t for o, x in of for t in ([chr(x)] if str(o) == "LITERAL" else [chr(x[0]), chr(x[1])] if str(o) == "RANGE" else ["7"] if "DIGIT" in str(x) else ["x"])]
        out = [a + b for a in out for b in more]
    return out


def _samples(pattern, rng, n):
    every = _alternatives(re._parser.parse(pattern))
    return every if len(every) <= n else rng.sample(every, n)


def test_license_rules_match_only_texts_with_one_of_their_words():
    rng = random.Random(31)
    rules = license_rules.signatures()
    assert len({pattern for *_, pattern in rules}) == len(rules)
    names = [(words, name) for words, of in license_rules.FAMILIES for _, name in of]
    for (label, _, _, words, pattern), name in itertools.zip_longest(rules, names):
        bare = name[1] if name else pattern
        for t in _samples(bare, rng, 400):
            assert re.fullmatch(pattern, t) and set(t.split()) & set(words), (label, t)
        if name:
            tag = license_rules.TAG + label.replace("-", " ").replace(".", " ")
            assert re.fullmatch(pattern, tag) and "spdx" in words


def plain_scan(text):
    """Labels and score without any prefilter."""
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(lower))
    t = f" {' '.join(words)} "
    grants = license_rules.GRANT[3 : license_rules.GRANT.index(")")].split("|")
    names = sum(len(r) for _, r in license_rules.FAMILIES)
    found = []
    for i, (label, p, w, _, pattern) in enumerate(license_rules.signatures()):
        for m in re.finditer(f"(?<= )(?:{pattern})(?= )", t):
            first = t.count(" ", 0, m.start()) - 1
            if i < names and m[0].startswith(license_rules.TAG):
                p_, w_ = 4, 1.0
            elif i < names and m[0].split()[0] in grants:
                p_, w_ = 3, 0.9
            else:
                p_, w_ = p, w
            found.append((first, -(first + m[0].count(" ")), -p_, i, label, w_))
    found.sort()
    stays = [s for k, s in enumerate(found) if not any(o[1] <= s[1] and o[2] <= s[2] for o in found[:k])]
    base = {label for phrase, label in licenses.BASE.items() if f" {phrase} " in t}
    weight = max((s[5] for s in stays), default=0.0)
    return sorted(base | {s[4] for s in stays}), max(weight, 0.7) if base else weight


def test_license_scan_equals_a_scan_without_prefilter(spark):
    rng = random.Random(41)
    filler = "Software the of License KELVIN\u212a public \u0130stanbul domain by with General, version 2.0 cc".split()
    phrases = [p for *_, pattern in license_rules.signatures() for p in _samples(pattern.split("|(?:(?:licensed")[0], rng, 2)]
    phrases += [g + n for n in ("gpl v3", "the mit license", "apache license 2 0", "cc by 4 0", "bsd license") for g in _samples(license_rules.GRANT, rng, 3)]
    texts = []
    for _ in range(300):
        parts = [rng.choice(phrases) if rng.random() < 0.4 else " ".join(rng.choice(filler) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 8))]
        t = rng.choice([" ", ", ", "-", "\n"]).join(parts)
        texts.append(t.upper() if rng.random() < 0.2 else t)
    texts += phrases
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "i long, text string").repartition(4), keep=("text",)).collect()
    assert len(got) == len(texts)
    for r in got:
        labels, score = plain_scan(r.text)
        assert r.labels == labels and abs(r.score - score) < 1e-9, r.text


def test_licenses_without_a_stray_keyword(spark):
    want = {
        "licensed under the EPL v1.0": "epl-1.0", "GPL v1": "gpl-1.0", "AGPL v1": "agpl-1.0", "Unauthorized copying of this file": "proprietary",
        "unless required by applicable law or agreed to in writing, software distributed under the License": "apache-2.0",
    }
    got = licenses.scan(spark.createDataFrame([(t,) for t in want], "text string"), keep=("text",)).collect()
    assert all(want[r.text] in r.labels and r.score >= 0.6 for r in got) and len(got) == len(want)


def test_license_suppression_equals_all_pairs(spark):
    rng = random.Random(8)
    rows = [(i, [(a := rng.randint(0, 12), a + rng.randint(0, 6), rng.randint(1, 4), k, f"L{k}", k / 10) for k in range(rng.randint(0, 8))]) for i in range(150)]
    df = spark.createDataFrame(rows, "id int, spans array<struct<first:int,last:int,priority:int,rule:int,label:string,weight:double>>")
    for r in df.select("spans", licenses.resolve(F.col("spans")).alias("r")).collect():
        order = sorted(r.spans, key=lambda s: (s.first, -s.last, -s.priority, s.rule))
        stays = {s.label for i, s in enumerate(order) if not any(t.last >= s.last and t.priority >= s.priority for t in order[:i])}
        assert set(r.r.labels) == stays
