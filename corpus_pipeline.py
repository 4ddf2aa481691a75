"""Corpus pipeline: language ID, near-duplicate removal, decontamination, mixing, token output.

Each stage is an operator of kairoframe.llm over all that the stage before it kept; `run` writes each stage's result
to the shared folder and reads it again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kairoframe.llm import decontaminate, jaccard_join, language_id, mixing, token_output
from kairoframe.llm.common import stored, table


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    return language_id.recognised(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, similarity of 0.8 or more."""
    return jaccard_join.deduplicated(docs, jaccard_join.Rule(5, 80, 100))


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture uses them: each at least once, no source over twice as often as another."""
    return mixing.mixed(docs, mixing.Target(max_repetition=2.0))


def training_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shards of token ids in training order."""
    return token_output.shards(docs)


STAGES = [
    ("language ID", languages),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_free),
    ("mixing sources", target_mix),
    ("token-ID output", training_order),
]

#: SQL cannot express the stages (segmentations, hashes, encodings); tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage{i + 1}")
    return docs
