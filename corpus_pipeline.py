"""Training-corpus pipeline: toxicity, exact dedup, near-dedup, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and all rows its predecessor kept. All but the
last return the columns of `docs`. Rows and their columns are never changed before the
last stage, which adds `n_tokens`, `ids` and `decoded`.

Rows are judged and kept one by one: neither missing nor repeated ids take a row with them.
Toxicity and decontamination let rows through where they lie, the two dedup stages join
narrow keys of rows (`common.keyed`), so no stage shuffles texts to apply a decision.
Defined results: a null or empty text is neither toxic by its words nor leaked, and equal to
other empty texts, of which one stays; very long texts are read whole by every stage; of
equal texts and of near copies the row that `exact_dedup` and `near_dedup` name stays; an
empty table gives an empty table; other columns pass through, whatever their names, but for
`n_tokens`, `ids` and `decoded`, which the last stage replaces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gantry.llm import decontaminate, exact_dedup, near_dedup, sentencepiece_codec, toxicity
from gantry.llm.common import Scratch, cut, table
from gantry.llm.queries import tokenizer_file


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below a half."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more on five-word shingles."""
    return near_dedup.keep_one(docs, k=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, their number, and the text they decode to."""
    return sentencepiece_codec.encode(docs, tokenizer_file(spark, "piece_bpe_32k.model"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("sentencepiece", encode),
]

#: SQL can express neither the toxicity model nor the segmentation; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result on `documents`; what each stage before it kept is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with Scratch(spark) as scratch:  # what a stage leaves goes, but for its result
            kept = scratch.keep(cut(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}"))
        if hasattr(docs, "cut_path"):
            Scratch(spark).delete(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
