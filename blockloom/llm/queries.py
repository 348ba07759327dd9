"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm import decontaminate, lengths, line_dedup, minhash, packing, quality, suffix_dedup, token_files, vectors, warc

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_tokens(_table(spark, sf_dir, "documents"), BYTE_BPE, end_id=0)
    return token_files.read_documents(manifest)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.suffix_dedup(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(_table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.line_dedup(_table(spark, sf_dir, "documents"), host_col="source", counts=("n_lines", "n_dropped"))
    return cut.select("doc_id", "n_lines", "n_dropped", F.md5("text").alias("kept_md5"))


OP4_SQL = """
WITH p AS (SELECT doc_id, source, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
counts AS (
  SELECT source, line, count(*) AS n
  FROM (SELECT source, unnest(list_distinct([trim(x) FOR x IN ls IF trim(x) <> ''])) AS line FROM p WHERE source IS NOT NULL)
  GROUP BY source, line),
totals AS (SELECT source, count(*) AS total FROM p GROUP BY source),
bad AS (
  SELECT c.source, list(c.line) AS lines FROM counts c JOIN totals t ON c.source = t.source
  WHERE c.n > 0.1::DOUBLE * t.total GROUP BY c.source),
k AS (
  SELECT p.doc_id, p.text, p.ls, CASE WHEN b.lines IS NULL THEN p.ls ELSE [x FOR x IN p.ls IF NOT list_contains(b.lines, trim(x))] END AS kept
  FROM p LEFT JOIN bad b ON p.source = b.source)
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(ls) END::BIGINT AS n_lines,
  CASE WHEN text IS NULL THEN 0 ELSE len(ls) - len(kept) END::BIGINT AS n_dropped,
  CASE WHEN text IS NULL THEN NULL ELSE md5(array_to_string(kept, chr(10))) END AS kept_md5
FROM k
"""


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.derive_pages(_table(spark, sf_dir, "pages"))
    return made.select("page_id", "response_id", "metadata_id", "conversion_id", "target_uri", "payload_digest", "http_status",
                       *(F.length(c).cast("long").alias(f"{c}_bytes") for c in ("metadata", "conversion")), *(F.sha2(c, 256).alias(f"{c}_sha256") for c in ("metadata", "conversion")),
                       F.length("text").cast("long").alias("text_chars"), "status")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), WORD_BPE, end_id=2)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(_table(spark, sf_dir, "documents"), words=4, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.suffix_sums(lengths.histogram(_table(spark, sf_dir, "documents"), BYTE_BPE))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = quality.score(docs.select("doc_id", "text"), quality.train(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", F.when(F.col("score") >= quality.KEEP, 1).otherwise(0).alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_multi_index": op3_multi_index,
    "op4_line_dedup": op4_line_dedup,
    "op5_warc": op5_warc,
    "op6_decontaminate": op6_decontaminate,
    "op7_packing": op7_packing,
    "op8_minhash": op8_minhash,
    "op9_token_counts": op9_token_counts,
    "op10_quality": op10_quality,
}

ORACLE_SQL: dict[str, str] = {"op4_line_dedup": OP4_SQL}
