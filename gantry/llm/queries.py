"""The contract queries of the operators, their parameters, and SQL where it can express them."""

from __future__ import annotations

import importlib.util
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gantry.llm import decontaminate, exact_dedup, language_id, near_dedup, quality, secret_scan, sentencepiece_codec, suffix_dedup, token_counts, toxicity
from gantry.llm.common import shared_dir, table


def tokenizer_file(spark: SparkSession, name: str) -> str:
    """Where a public vocabulary file lies: under `spark.gantry.tokenizers`, else in the installed package."""
    folder = spark.conf.get("spark.gantry.tokenizers", None)
    if folder:
        return f"{folder}/{name}"
    spec = importlib.util.find_spec("public_tokenizers")
    return str(Path(spec.origin).parent / name) if spec and spec.origin else f"/opt/tokenizers/{name}"


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.summary(secret_scan.scan(table(spark, sf_dir, "documents")))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.find_duplicates(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.find_groups(table(spark, sf_dir, "documents"), k=2, percent=80)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_all(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("evidence")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as one batch of inserts into a new rollup, and its totals."""
    docs = table(spark, sf_dir, "documents").select("source", "lang", "text")
    counted = token_counts.count_tokens(docs, tokenizer_file(spark, "byte_bpe_50k.tiktoken"))
    rollup = token_counts.Rollup(spark, f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}")
    rollup.commit("documents", counted.withColumns({"tokenizer": F.lit("byte_bpe_50k"), "sign": F.lit(1)}))
    return rollup.totals()


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.grade_all(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digests(table(spark, sf_dir, "documents"), tokenizer_file(spark, "piece_bpe_32k.model"))


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_decontaminate": op2_decontaminate,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_language_id": op4_language_id,
    "op5_near_dedup": op5_near_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_token_counts": op7_token_counts,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_quality": op9_quality,
    "op10_sentencepiece": op10_sentencepiece,
}

ORACLE_SQL = {
    "op2_decontaminate": r"""
        WITH t AS (SELECT doc_id AS id, false AS item, text FROM documents UNION ALL SELECT item_id, true, text FROM benchmark),
        w AS (SELECT id, item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM t),
        s AS (SELECT DISTINCT id, item, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM w),
        i AS (SELECT id AS item_id, s, count(*) OVER (PARTITION BY id) AS n_shingles FROM s WHERE item),
        m AS (SELECT d.id AS doc_id, item_id, n_shingles, count(*) AS n_shared FROM s d JOIN i USING (s) WHERE NOT d.item GROUP BY ALL)
        SELECT doc_id, item_id, n_shared, n_shingles, n_shared / n_shingles AS containment FROM m WHERE n_shared >= 0.8 * n_shingles""",
    "op3_exact_dedup": r"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS cp, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS sha FROM documents),
        k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY sha ORDER BY cp DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY sha) AS group_size FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha AS text_sha256 FROM k""",
}
