"""The pipeline's stages: what each rejects and keeps."""

import gc
import os
import random
import weakref

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline as cp  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from quire.llm import langid, packing, perplexity  # noqa: E402
from quire.llm.common import shared_dir, write_shared  # noqa: E402


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(11)
    vocab = {"en": ["the", "of", "and", "with", "that", "which"], "de": ["der", "und", "nicht", "mit", "eine", "auf"]}
    made = {k: ["".join(rng.choice("abcdefghik") for _ in range(rng.randint(2, 7))) for _ in range(400)] for k in vocab}

    def text(lang, n=150):
        return " ".join(rng.choice(vocab[lang]) if rng.random() < 0.5 else rng.choice(made[lang]) for _ in range(n))

    passage = text("en", 60)
    rows = [(i, text("en" if i % 2 else "de"), "en" if i % 2 else "de", "s") for i in range(120)]
    rows += [(200, rows[3][1], "en", "s"), (201, rows[4][1] + " und", "de", None)]  # an exact and a near copy
    rows += [(210, text("en") + " " + passage + " " + text("en"), "en", "s"), (211, passage + " " + text("en", 300), "en", "s")]
    rows += [(220, None, "en", "s"), (221, "", None, "s"), (222, "too short", "en", "s"), (223, "12 34 56 " * 10 + " ".join(map(str, range(100, 200))), None, "s"), (224, "again and again and " * 60, "en", "s"), (None, text("en"), "en", "s"), (7, text("en"), "en", "s")]
    return spark.createDataFrame([(i, t, g, s, len(t or "")) for i, t, g, s in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark, table, tmp_path):
    docs, seen = table, []
    for i, (name, stage) in enumerate(cp.STAGES):
        path = str(tmp_path / str(i))
        stage(spark, docs, "").write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
        if i < 4:
            assert set(docs.columns) == set(cp.COLUMNS), name
    clean = set(range(120)) | {200, 201, 210, 211, None}
    assert clean <= seen[0] and not seen[0] & {220, 221, 222, 224}
    assert clean <= seen[1] and 223 not in seen[1]
    assert seen[2] == clean - {200, 201}
    assert seen[3] == seen[2] and seen[4] == seen[3]
    assert docs.where('doc_id = 7').count() >= 2  # rows that repeat an id are documents of their own
    after = {r.doc_id: r for r in spark.read.parquet(str(tmp_path / "3")).collect()}
    assert len(after[210].text.split()) == 300 and len(after[211].text.split()) == 300
    before = {r.doc_id: r.text for r in table.collect()}
    assert after[5].text == before[5] and after[210].n_chars == len(after[210].text)


def test_run_and_empty_table(spark, table, tmp_path):
    table.write.parquet(str(tmp_path / "full" / "documents.parquet"))
    assert cp.run(spark, str(tmp_path / "full")).select("doc_id").distinct().count() == 123  # with the null id
    table.where("false").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert cp.run(spark, str(tmp_path / "none")).count() == 0


def folders(spark):
    return {f for f in os.listdir(shared_dir(spark).removeprefix("file:")) if f.startswith("quire-")}


def labels(names):
    return {f.removeprefix("quire-").rsplit("-", 1)[0] for f in names}


def test_folders_that_are_no_longer_read_go(spark, table, tmp_path):
    docs, before = table, folders(spark)
    own = [{"quality"}, set(), {"simhash-rows", "simhash-fps"}, {"substring-settled"}, {"packing-ids"}]
    for i, (name, stage) in enumerate(cp.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        assert labels(folders(spark) - before) - {"simhash-large"} == own[i], name
    before = folders(spark)
    table.write.parquet(str(tmp_path / "documents.parquet"))
    got = cp.run(spark, str(tmp_path))
    assert labels(folders(spark) - before) == {"packing-ids"}
    assert got.count() == docs.count()


def test_results_that_are_not_written_yet_stay(spark, table, tmp_path):
    """The docs of a stage may read what the stage before left, and other runs go on beside it."""
    (_, quality), (_, language), (_, near_dedup) = cp.STAGES[:3]
    at = str(tmp_path)
    passed, other = quality(spark, table, at), quality(spark, table.where("doc_id < 60"), at + "/other")
    told = language(spark, passed, at)
    kept = {r.doc_id for r in near_dedup(spark, told, at).collect()}
    assert kept == set(range(120)) | {210, 211, None}
    assert told.where("doc_id = 200").count() == 1
    assert other.where("doc_id < 60").count() >= 60


def test_texts_are_held_once(spark, table):
    docs, keep = write_shared(table, "test"), {c: F.col(c) for c in cp.COLUMNS}
    model = langid.fit(docs)
    grams = write_shared(perplexity.kneser_ney(perplexity.count_ngrams(docs)), "test")
    for once, twice in (
        (langid.identify(docs, model, keep=keep, text_in="text"), langid.identify(docs, model, keep=keep)),
        (perplexity.score(docs, grams, "text", keep, text_in="text"), perplexity.score(docs, grams, "text", keep)),
        (perplexity.score(docs, grams, "text", keep, 0, "text"), perplexity.score(docs, grams, "text", keep, 0)),
    ):
        rows = [sorted(map(str, t.drop("log_ppl").collect())) for t in (once, twice)]
        assert rows[0] == rows[1] and len(rows[0]) == table.count()
    # what the pipeline sends to Python
    plan = cp.language(spark, docs, "once")._jdf.queryExecution().analyzed().toString()
    assert "MapInArrow" in plan and "AS _t#" not in plan


def test_a_worker_keeps_one_operators_caches():
    path = cp.public_tokenizers.path("word_bpe_49k.json")
    encoder = weakref.ref(packing._encoder(path))
    assert packing._encoder(path) is encoder()
    assert perplexity.text_rules("one two three four five six seven eight nine ten")[0] == 10
    gc.collect()
    assert encoder() is None
