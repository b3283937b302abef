"""The corpus pipeline: stages in order, each reading what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyspark.llm.decontamination import drop_leaks
from tallyspark.llm.mixing import mixed_documents
from tallyspark.llm.pii import mask_pii
from tallyspark.llm.simhash import keep_one_of_copies
from tallyspark.llm.toxicity import drop_toxic
from tallyspark.session import materialize, read_table, scratch_path, scratch_scope, spread


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that score as toxic."""
    return drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles alike to 0.8 or more."""
    return keep_one_of_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a benchmark passage."""
    return drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return mask_pii(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the copies and words that the mix takes of each."""
    return mixed_documents(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii", pii), ("mixing", mixing)]
#: No SQL: training, fingerprints and random rounding are not expressible; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(read_table(spark, sf_dir, "documents"))
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        with scratch_scope(spark):  # what the stage wrote on its way goes once its result is written
            docs = materialize(stage(spark, docs, sf_dir), path=path)
    return STAGES[-1][1](spark, docs, sf_dir)
