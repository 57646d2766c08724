"""The corpus pipeline: quality rules, quality classifier, near-duplicate removal, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns documents with the columns
it was given; the last returns the packed pieces. Rules and classifier judge each row where it lies, without a shuffle
of texts. Stages that learn from labels read `labels` beside the documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evidence.llm import queries
from evidence.llm.common import materialise, table
from evidence.llm.dart_minhash import one_of_each
from evidence.llm.packing import best_fit_packing
from evidence.llm.quality_classifier import keep_good
from evidence.llm.quality_rules import keep_ruled
from evidence.llm.soft_mixing import mixed


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and don't diverge from every language."""
    return keep_ruled(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at least the threshold."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class, that with the least doc_id; texts without words all stay."""
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says."""
    return mixed(docs, queries.domains(table(spark, sf_dir, "labels"), low=False), queries.PIPELINE_TARGETS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in their sequences."""
    return best_fit_packing(docs, queries.tokenizer_path(queries.WORD_BPE))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: Learnt models and tokenizers aren't expressible in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
