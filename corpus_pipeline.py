"""From raw documents to packed training sequences.

Each stage takes (spark, docs, folder) and returns the documents it keeps, with
the columns of ``documents``; the last one returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldloom.llm import decontaminate, near_dedup, packing, quality_classifier, quality_rules
from fieldloom.llm.queries import vocabulary
from fieldloom.session import materialise, prepare


def quality_rule_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Lines of too many documents of a source go, then documents that fail the rules."""
    return quality_rules.clean_documents(docs)


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents of quality below a half go; the field is fitted on labelled documents among ``docs``."""
    return quality_classifier.keep_good(docs, spark.read.parquet(f"{folder}/labels.parquet"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return near_dedup.keep_representatives(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The token ids of every piece, with its sequence and its place there."""
    return packing.pack(packing.tokenised(docs, vocabulary(), end_id=1))


STAGES = [
    ("quality_rules", quality_rule_stage),
    ("quality_classifier", quality_classifier_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

# Classification, signatures and tokenisation have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = prepare(spark).read.parquet(f"{folder}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, folder))
    return STAGES[-1][1](spark, docs, folder)
