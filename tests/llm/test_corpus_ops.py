"""Near-duplicates, repeated passages, quality rules and archives against brute force."""

import base64
import hashlib
import math
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quire.llm import perplexity, simhash, substring, warc
from quire.llm.components import components

WORD = re.compile("[^\x20\x09-\x0d]+")


def corpus(spark, n=60, seed=1):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    passage = " ".join(rng.choice(vocab) for _ in range(50))
    texts = [None, "", " \n ", "one", "one two", "One two"]
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.choice([5, 34, 35, 36, 90, 400]))]
        if i % 4 == 0:
            words.insert(len(words) // 2, passage)
        if i % 10 == 0:
            words += words[-40:]
        texts.append(rng.choice([" ", "\n", "\t "]).join(words))
    texts += [texts[10]] * 3 + [texts[12] + " x", "y " + texts[14], " ".join(["same"] * 120)]
    rows = [(i, t, rng.choice(["en", "fr", None]), "s", "x", "y") for i, t in enumerate(texts)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, fp string, n_words string").repartition(4)


def plain_removal(rows, width=35):
    count = Counter()
    words = {i: WORD.findall(t or "") for i, t, *_ in rows}
    for w in words.values():
        count.update(tuple(w[s : s + width]) for s in range(len(w) - width + 1))
    out = {}
    for i, w in words.items():
        keep = [True] * len(w)
        for s in range(len(w) - width + 1):
            if count[tuple(w[s : s + width])] > 1:
                keep[s : s + width] = [False] * width
        out[i] = (len(w), len(w) - sum(keep), " ".join(x for x, k in zip(w, keep) if k))
    return out


@pytest.mark.parametrize("chunk, shard", [(4_000_000, 2_000_000), (2_000, 50)])
def test_substring_dedup(spark, monkeypatch, chunk, shard):
    monkeypatch.setattr(substring, "PER_SHARD", shard)
    monkeypatch.setattr(substring, "CHUNK_BYTES", chunk)
    rows, df = corpus(spark)
    want = plain_removal(rows)
    got = substring.remove_repeats(df, digest=True).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in got} == {i: (n, r, hashlib.sha256(t.encode()).hexdigest()) for i, (n, r, t) in want.items()}
    assert sum(r for _, r, _ in want.values()) > 1000


def test_substring_text_keeps_its_layout(spark):
    rows, df = corpus(spark)
    want = plain_removal(rows)
    for r in substring.remove_repeats(df, keep=("doc_id", "text", "lang")).collect():
        n, removed, kept = want[r.doc_id]
        assert r.n_removed == removed and " ".join(WORD.findall(r.kept)) == kept
        assert removed or r.kept == (r.text or "")
    assert substring.remove_repeats(df.where("false")).count() == 0


def test_index_between_batches(spark, tmp_path):
    from quire.llm.substring_index import Index

    rows, df = corpus(spark, 40)
    path = str(tmp_path / "index")
    index, seen, width, answers = Index(spark, path), Counter(), 35, []
    for batch in range(4):
        part = [r for r in rows if r[0] % 4 == batch]
        words = {r[0]: WORD.findall(r[1] or "") for r in part}
        for w in words.values():
            seen.update(tuple(w[s : s + width]) for s in range(len(w) - width + 1))
        want = {}
        for i, w in words.items():
            keep = [True] * len(w)
            for s in range(len(w) - width + 1):
                if seen[tuple(w[s : s + width])] > 1:
                    keep[s : s + width] = [False] * width
            want[i] = (len(w), len(w) - sum(keep))
        mine = df.where(F.col("doc_id") % 4 == batch)
        got = index.append(mine, f"b{batch}").collect()
        assert {r.doc_id: (r.n_words, r.n_removed) for r in got} == want
        answers.append(want)
        index = Index(spark, path)  # reopened
        spark.conf.set("spark.sql.shuffle.partitions", "3" if batch % 2 == 0 else "4")  # its buckets stay
        assert len(index.state["runs"]) <= 2
    for batch in (1, 3):  # a batch that is tried again is answered alike and not added
        mine = df.where(F.col("doc_id") % 4 == batch)
        assert {r.doc_id: (r.n_words, r.n_removed) for r in index.append(mine, f"b{batch}").collect()} == answers[batch]
    entries = sum(r.count() for r in index.runs())
    index.compact()
    assert len(index.state["runs"]) == 1 and index.runs()[0].count() == entries
    assert index.append(df.where("false"), "empty").count() == 0
    with pytest.raises(ValueError):
        Index(spark, path, width=20)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_index_ignores_what_no_manifest_names(spark, tmp_path):
    """A batch or compaction that was lost before its manifest leaves the index as it was."""
    from quire.llm.substring_index import Index

    rows, df = corpus(spark, 20)
    index = Index(spark, str(tmp_path / "index"))
    first = index.append(df.where("doc_id < 14"), "a").count()
    lost = Index(spark, str(tmp_path / "index"))
    lost._commit = lambda: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        lost.append(df.where("doc_id >= 14"), "b")
    again = Index(spark, str(tmp_path / "index"))
    assert list(again.state["batches"]) == ["a"] and len(again.state["runs"]) == 1
    got = again.append(df.where("doc_id >= 14"), "b").collect()
    whole = plain_removal(rows)
    removed = {r.doc_id: r.n_removed for r in got}
    # the newer documents repeat themselves and older ones, as over the whole table but for what only older ones hold
    assert first + len(got) == len(rows) and removed == {i: whole[i][1] for i in removed}


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[j : j + 3]) for j in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, radius=3):
    ids = sorted(fps)
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if (fps[a] ^ fps[b]).bit_count() <= radius and label[a] > label[b]:
                    label[a], changed = label[b], True
    return label


def test_simhash(spark):
    rows, df = corpus(spark)
    fps = {i: plain_fingerprint(t) for i, t, *_ in rows}
    want = plain_components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in fps}
    assert simhash.near_duplicates(df.where("false")).count() == 0


def test_covering_masks_miss_no_pair():
    masks = simhash.masks(3)
    assert len(masks) == 15
    rng = random.Random(1)
    for _ in range(3000):
        diff = sum({1 << rng.randrange(64) for _ in range(3)})
        assert any(not diff & m for m in masks)


@pytest.mark.parametrize("limit", [1, 3, 1024])
def test_large_buckets_are_split_exactly(spark, limit):
    rng = random.Random(6)
    centre = [rng.getrandbits(64) for _ in range(3)]
    fps = {0, *centre}
    for c in centre:
        for _ in range(60):
            x = c
            for _ in range(rng.randint(1, 5)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    want = plain_components(dict(zip(sorted(fps), sorted(fps))))
    df = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    got = simhash.links(df, limit=limit).collect()
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 3 for r in got)
    joined = {r.node: r.component for r in components(spark.createDataFrame(got, "a long, b long")).collect()} if got else {}
    groups, expected = {}, {}
    for x in fps:
        groups.setdefault(joined.get(simhash._signed(x), simhash._signed(x)), set()).add(x)
        expected.setdefault(want[x], set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_components_of_a_path_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def plain_rules(text):
    w, t = WORD.findall(text or ""), text or ""
    lines = [x for x in t.split("\n") if WORD.search(x)]
    at = {}
    for j in range(len(w) - 7):
        at.setdefault(tuple(w[j : j + 8]), []).append(j)
    hit = [False] * len(w)
    for js in at.values():
        for j in js if len(js) > 1 else ():
            hit[j : j + 8] = [True] * 8
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), sum(hit)


def test_quality_rules(spark):
    rows, df = corpus(spark)
    df = df.withColumn("text", F.when(F.col("doc_id") == 20, F.concat("text", F.lit("\nx #\nx #\n\n\n|<>"))).otherwise(F.col("text")))
    texts = {r.doc_id: r.text for r in df.collect()}
    small = perplexity.judge(df).collect()
    for r in small:
        want = plain_rules(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.kept and r.base_failed) and (r.kept or r.base_failed or not r.lower <= r.perplexity <= r.upper)
        assert (r.perplexity is None) == (want[0] == 0)
    assert sum(r.kept for r in small) > 30
    joined = {r.doc_id: r for r in perplexity.judge(df, max_broadcast=10).collect()}
    for r in small:  # the way by joins gives the same figures
        o = joined[r.doc_id]
        assert r.kept == o.kept and (r.perplexity is None or abs(r.perplexity - o.perplexity) < 1e-6 * r.perplexity)
    assert perplexity.judge(df.where("false")).count() == 0


def plain_kneser_ney(texts):
    """Probability of a byte after four others, by the textbook."""
    order, top = perplexity.ORDER, Counter()
    for t in texts:
        b = perplexity.normal(t)
        top.update(b[i : i + order] for i in range(len(b) - order + 1))
    counts = {order: top}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    ds = {k: perplexity.discounts(Counter(c.values())) for k, c in counts.items()}
    by = {k: {} for k in counts}
    for k, c in counts.items():
        for g, n in c.items():
            by[k].setdefault(g[:-1], []).append(n)

    def p(g):
        k = len(g)
        if not k:
            return 1 / 256
        own = by[k].get(g[:-1])
        if own is None:
            return p(g[1:])
        d = ds[k]
        n = counts[k].get(g, 0)
        return (n - (d[min(n, 3) - 1] if n else 0)) / sum(own) + sum(d[min(x, 3) - 1] for x in own) / sum(own) * p(g[1:])

    return p


def test_model_is_kneser_ney(spark):
    rows, df = corpus(spark, 15)
    model = perplexity.Arrays(perplexity.kneser_ney(perplexity.count_ngrams(df)).toArrow())
    p = plain_kneser_ney([t for _, t, *_ in rows])
    for g in (b"    o", b"one t", b"abc d", b"zzzzz", b"e zzq", b" same", b"ame s", b"    \xc3", b"q a b"):
        got = model.logp(np.array([int.from_bytes(g, "big")], np.uint64))[0]
        assert abs(got - np.log(p(g))) < 1e-4, g
    for ctx in (b"one ", b"    ", b"abcd"):
        keys = np.array([int.from_bytes(ctx + bytes([c]), "big") for c in range(256)], np.uint64)
        assert abs(np.exp(model.logp(keys)).sum() - 1) < 1e-3


def test_archives_round_trip(spark, tmp_path):
    rng = random.Random(9)
    pages = [(i, f"http://h/{i}?a=\n", rng.choice(["<p>é</p>\r\n\r\nWARC/1.1", "", None, "x" * 50_000, f"own {i}"])) for i in range(60)] + [(7, None, "twice"), (7, None, "twice"), (None, "http://h", "no id")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5).withColumn("payload", F.lit("clash"))
    path = str(tmp_path / "warc")
    got = warc.captures(df, path=path).collect()
    assert len(got) == len(pages) and all(r.request and r.metadata for r in got)
    least = {}
    for i, _, t in pages:
        least[t or ""] = min(least.get(t or "", 10**9), 10**9 if i is None else i)
    want = Counter()
    for i, _, t in pages:
        raw = (t or "").encode()
        first = least[t or ""]
        other = first != 10**9 and first != i
        want[i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if other else "response", first if other else None] += 1
    assert Counter((r.capture.page_id, r.capture.payload_bytes, r.capture.payload_digest, r.capture.type, r.capture.refers_to) for r in got) == want
    bodies = {bytes(r.capture.payload).decode() for r in got if r.capture.type == "response"}
    assert bodies == {t or "" for _, _, t in pages} and all(r.capture.payload_ok for r in got)
    records = warc.read_archives(spark, path)
    assert records.groupBy("type").count().count() == 4 and records.count() == 3 * len(pages)
    lone = warc.assemble(records.where("type <> 'request'"))
    assert lone.where("request is null and metadata is not null").count() == len(pages)
    big = warc.captures(df, min_bytes=10**6).collect()
    assert {r.capture.type for r in big} == {"response"}
    assert warc.captures(df.where("false")).count() == 0


def _warc(kind, rid, block=b"", *more):
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", *more, f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_archives_of_others(spark, tmp_path):
    import gzip

    http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nbody" + b"z" * 200_000
    good = [
        _warc("warcinfo", "<i>", b"software: x\r\n"),
        _warc("request", "<q1>", b"GET / HTTP/1.1\r\n\r\n"),  # named by its response
        _warc("response", "<r1>", http, "WARC-Concurrent-To: <q1>", "Content-Type: application/http; msgtype=response", "warc-payload-digest: md5:abc"),
        _warc("metadata", "<m1>", b"", "WARC-Concurrent-To: <r1>", "WARC-Concurrent-To: <r2>"),  # of two captures
        _warc("revisit", "<r2>", b"", "WARC-Refers-To: <r1>", "WARC-Target-URI: http://a/", " b"),
        _warc("request", "<q9>", b"", "WARC-Concurrent-To: <nobody>"),
    ]
    (tmp_path / "w").mkdir()
    files = {"a.warc.gz": b"".join(map(gzip.compress, good)), "b.warc": b"".join(good).replace(b"1>", b"3>").replace(b"2>", b"4>")}
    files |= {"cut.warc.gz": gzip.compress(_warc("response", "<r5>", b"HTTP/1.1 200 OK\r\nContent-Length: 1\r\n\r\nx")) + gzip.compress(good[2])[:-60], "none.warc": b"", "bad.warc": b"hello", "short.warc": good[2][:-50]}
    for name, raw in files.items():
        (tmp_path / "w" / name).write_bytes(raw)
    records = warc.read_archives(spark, str(tmp_path / "w"), glob="*.warc*")
    assert records.where("error is not null").count() == 3 and records.where("error is null").count() == 13
    got = {r.record_id: r for r in warc.assemble(records).collect()}
    assert set(got) == {"<r1>", "<r2>", "<r3>", "<r4>", "<r5>"}
    for a, b in (("1", "2"), ("3", "4")):
        r = got[f"<r{a}>"]
        assert r.request.record_id == f"<q{a}>" and r.metadata.record_id == f"<m{a}>" and got[f"<r{b}>"].metadata.record_id == f"<m{a}>"
        assert r.capture.payload_bytes == 200_004 and bytes(r.capture.payload)[:5] == b"bodyz" and r.capture.payload_ok is None and r.capture.target_uri is None
        v = got[f"<r{b}>"].capture
        assert v.payload_bytes is None and v.payload is None and v.refers_to_id == f"<r{a}>" and v.target_uri == "http://a/ b"
    assert got["<r5>"].capture.payload_bytes == 1 and got["<r5>"].request is None


def test_archive_files_are_members_of_bounded_size(spark, tmp_path):
    df = spark.createDataFrame([(i, "http://h/x", random.Random(i).randbytes(3000).hex()) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(df, str(tmp_path / "w"), segment_bytes=30_000)
    files = [f.read_bytes() for f in (tmp_path / "w").glob("part-*")]
    assert len(files) > 3 and all(f.count(b"\x1f\x8b\x08\x00") >= 4 and len(f) < 60_000 for f in files)
    import gzip

    assert sum(gzip.decompress(f).count(b"WARC/1.1\r\n") for f in files) == 120
    assert warc.read_archives(spark, str(tmp_path / "w")).where("error is null").count() == 120


def test_one_row_of_each_group_stays(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(40)) for _ in range(6)]
    rows = [(5, texts[0], "a"), (3, texts[0], "b"), (None, texts[0], "c"), (None, texts[1], "d"), (None, texts[1], "e"), (7, texts[2], "f"), (7, texts[3], "g"), (7, texts[3], "h"), (1, None, "i"), (2, "", "j")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string").coalesce(1)
    got = {r.fp for r in simhash.representatives(df, ("doc_id", "fp")).collect()}
    assert got == {"b", "d", "f", "g", "i"}
    assert simhash.representatives(df.where("false"), ("doc_id",)).count() == 0


def test_the_shared_folder_is_emptied(spark):
    from quire.llm import common

    common.release(spark)
    kept = common.write_shared(spark.range(3), "test")
    assert kept.count() == 3 and os.path.isdir(common._WRITTEN[-1])
    path = common._WRITTEN[-1]
    common.release(spark)
    assert not os.path.exists(path) and not common._WRITTEN


def test_bands_by_brute_force(spark):
    rows, df = corpus(spark, 120, seed=4)
    got = perplexity.judge(df).collect()
    by = {}
    for r in got:
        if not r.base_failed and r.perplexity is not None:
            by.setdefault(r.lang, []).append(math.floor(math.log(r.perplexity) / perplexity.STEP + 1e-9))
    assert None in by and len(by) == 3
    verdicts = set()
    for r in got:
        bins = sorted(by[r.lang])
        q1, q3 = (min(b for b in bins if sum(x <= b for x in bins) >= f * len(bins)) * perplexity.STEP for f in (0.25, 0.75))
        q3 += perplexity.STEP
        size = len(b" ".join((rows[r.doc_id][1] or "").encode().lower().split()))
        wide, scatter = max(q3 - q1, 0.02), math.sqrt(max(size, 1))
        low, high = q1 - 3 * wide - 6 / scatter, q3 + 2 * wide + 3 / scatter
        assert abs(math.log(r.lower) - low) < 1e-9 and abs(math.log(r.upper) - high) < 1e-9
        inside = r.perplexity is not None and low <= math.log(r.perplexity) <= high
        assert r.kept == (inside and not r.base_failed)
        verdicts.add((r.base_failed, r.kept))
    assert len(verdicts) >= 2
