"""The registered queries of this subpackage: thin digests over the operators' own outputs."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.llm import bpe, digest, langid, licenses, packing, perplexity, simhash, substring, token_counts, warc
from quire.llm.common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.judge(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("kept", "kept_sha256")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.identify(docs, model, keep={"doc_id": F.col("doc_id"), "held_out": langid.held_out(F.col("doc_id"))})


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return token_counts.limits(token_counts.histogram(counts))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = digest.fingerprints_with_next(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = licenses.scan(table(spark, sf_dir, "documents"))
    base = F.col("base")
    return got.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(base).cast("long").alias("first_word"), F.array_max(base).cast("long").alias("last_word"), F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = warc.captures(table(spark, sf_dir, "pages"), payloads=False)
    c = "capture."
    return got.select(c + "page_id", c + "payload_bytes", c + "payload_digest", F.col(c + "type").alias("record_type"), c + "refers_to", F.col("request").isNotNull().alias("has_request"), F.col("metadata").isNotNull().alias("has_metadata"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoder = bpe.Encoder(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)
    ids = bpe.encode(table(spark, sf_dir, "documents"), encoder).withColumns({"n_tokens": (F.octet_length("ids") / 4).cast("long"), "ids_sha256": F.sha2("ids", 256)})
    back = bpe.decode(ids, encoder, keep=("doc_id", "n_tokens", "ids_sha256"))
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = (op1_quality_rules, op2_simhash, op3_substring_dedup, op4_language_id, op5_token_counts, op6_fingerprints, op7_license_scan, op8_warc, op9_byte_bpe, op10_packing)


def queries() -> dict:
    return {q.__name__: q for q in QUERIES}


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS b FROM pages),
d AS (SELECT page_id, strlen(b) AS payload_bytes, sha1(b) AS h, min(page_id) OVER (PARTITION BY b) AS least FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> least THEN least END AS refers_to, true AS has_request, true AS has_metadata
FROM d
"""


OP3_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS p FROM w WHERE len(ws) >= 35),
h AS (SELECT doc_id, p, md5(array_to_string(list_slice(ws, p, p + 34), ' ')) AS h FROM s),
again AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS i FROM h WHERE h IN (SELECT h FROM again)),
words AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""


def oracle_sql() -> dict:
    return {"op3_substring_dedup": OP3_SQL, "op8_warc": OP8_SQL}
