"""A training-data pipeline of five stages; each works on all that the one before it kept.

The quality classifier rejects documents, one document of each group of near duplicates stays, documents that hold
passages of the benchmark go, the mixture is brought to its target shares of tokens (documents are repeated, none is
dropped), and the rest is written as token ids. Each stage takes and, but for the last, returns the columns of documents;
extra columns are carried, null texts count as empty, and an empty table passes through. A document that the tables of
labels or benchmark say nothing about is treated like any other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import common, decontamination, mixing, near_dedup, quality_model, queries, token_output

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score quality_model.THRESHOLD or more."""
    scored = quality_model.score(common.boxed(docs), common.table(spark, sf_dir, "labels"))
    return common.unboxed(scored.filter(F.col("score") >= quality_model.THRESHOLD), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, a similarity of 0.8)."""
    return near_dedup.representatives(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that match no benchmark item."""
    return decontamination.clean(docs, common.table(spark, sf_dir, "benchmark"))


def mixing_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; more copies where its domains need more tokens."""
    return mixing.mixed(docs, queries.domains(spark, sf_dir, docs), queries.TARGETS, least=1.0)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The written ids, read back: doc_id, start, n_tokens and ids_crc32 of every document and copy."""
    return token_output.round_trip(docs, queries.vocabulary())


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing", mixing_to_targets),
    ("token_output", token_ids),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return docs
