"""Corpus pipeline: quality rules, exact and near deduplication, mixing, and tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its output is written as Parquet and read
again as the next stage's ``docs``. All but the last return the columns of ``documents``. The mix repeats
documents, so from there on a doc_id can come more than once, and each row is encoded by draws of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import exact_dedup, mixing, near_dedup, quality_rules, sentencepiece_sampling
from larkspur.llm.shared import documents, staged, unstage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy rejects go."""
    return quality_rules.keep_documents(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id stays."""
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_dedup.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated, cut or left out until each source meets its target."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every document of the mix, new ones for each repetition."""
    return sentencepiece_sampling.sample_encode(sentencepiece_sampling.repetitions(docs), repetition_col="repetition")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("mix", mix),
    ("sentencepiece", encode),
]

#: Banding, sampling and lattices have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        before, docs = docs, staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        unstage(before)
    return STAGES[-1][1](spark, docs, sf_dir)
