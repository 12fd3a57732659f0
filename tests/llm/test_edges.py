"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for each operator."""

from __future__ import annotations

import pytest

from gantry.llm import decontaminate, exact_dedup, language_id, near_dedup, quality, secret_scan, sentencepiece_codec, suffix_dedup, token_counts, toxicity
from gantry.llm.queries import tokenizer_file
from tests.llm.fixtures import SCHEMA, clashing, odd_rows


def _labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 3 == 0 and 1 or 0) for i in range(17)] + [(4, None, None), (None, 1, 1), (999, 1, 1), (5, 0, 1)], "doc_id long, quality int, toxic int")


def _benchmark(spark):
    return spark.createDataFrame([(1, "same text here and there"), (2, None), (3, ""), (4, "one two"), (4, "one two"), (5, "not in any document at all today")], "item_id long, text string")


OPERATORS = {
    "secret_scan": lambda s, d: secret_scan.summary(secret_scan.scan(d)),
    "decontaminate": lambda s, d: decontaminate.find_leaks(d, _benchmark(s)),
    "remove_leaks": lambda s, d: decontaminate.remove_leaks(d, _benchmark(s)),
    "exact_dedup": lambda s, d: exact_dedup.find_duplicates(d),
    "keep_exact": lambda s, d: exact_dedup.keep_one(d),
    "language_id": lambda s, d: language_id.identify(d),
    "near_dedup": lambda s, d: near_dedup.find_groups(d, k=2),
    "keep_near": lambda s, d: near_dedup.keep_one(d),
    "toxicity": lambda s, d: toxicity.score_all(d, _labels(s)),
    "keep_clean": lambda s, d: toxicity.keep_clean(d, _labels(s)),
    "token_counts": lambda s, d: token_counts.count_tokens(d.select("source", "lang", "text"), tokenizer_file(s, "byte_bpe_50k.tiktoken")),
    "suffix_dedup": lambda s, d: suffix_dedup.digests(d),
    "quality": lambda s, d: quality.grade_all(d, _labels(s)),
    "encode": lambda s, d: sentencepiece_codec.encode(d, tokenizer_file(s, "piece_bpe_32k.model")),
    "codec_digests": lambda s, d: sentencepiece_codec.digests(d, tokenizer_file(s, "piece_bpe_32k.model")),
}
#: Operators that give a row for each row.
WHOLE = ("secret_scan", "language_id", "near_dedup", "toxicity", "suffix_dedup", "quality", "encode", "codec_digests", "token_counts", "exact_dedup")


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows(spark, name):
    rows = odd_rows()
    docs = clashing(spark.createDataFrame(rows, SCHEMA)).repartition(3)
    out = OPERATORS[name](spark, docs).collect()
    if name in WHOLE:
        assert len(out) == len(rows)


def test_documented_odd_results(spark):
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    by = lambda df: {(r["doc_id"]): r for r in df.collect()}
    secrets = by(OPERATORS["secret_scan"](spark, docs))
    assert (secrets[0]["n_assign"], secrets[0]["spans"]) == (0, "") and secrets[14]["n_assign"] == 1 and secrets[14]["n_access"] == 1
    lang = by(OPERATORS["language_id"](spark, docs))
    assert lang[0]["lang_pred"] == lang[1]["lang_pred"] == lang[2]["lang_pred"] == "und" and lang[0]["score"] == 0
    near = by(OPERATORS["near_dedup"](spark, docs))
    assert near[0]["n_shingles"] == near[2]["n_shingles"] == 0 and near[1]["component_id"] == 1
    assert near[6]["component_id"] == 5 and near[8]["component_id"] == 7 and near[16]["component_id"] == 15
    cut = by(OPERATORS["suffix_dedup"](spark, docs))
    assert cut[0]["n_bytes"] == 0 and cut[7]["n_removed"] == cut[7]["n_bytes"] and cut[10]["n_removed"] == 5000
    kept = OPERATORS["keep_exact"](spark, docs).filter("doc_id in (0, 1, 2, 3)").select("doc_id", "text").collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [(3, "\n\t"), (3, "another text of id three")]
