"""The corpus pipeline: language ID, exact and near copies, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept
and returns the documents that it keeps with their columns; the last returns
the packing.  ``run`` writes every stage to the shared folder and reads it
again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.common import documents, stage
from quillspark.llm.decontaminate import drop_contaminated
from quillspark.llm.exact_dedup import drop_exact_copies
from quillspark.llm.language import keep_identified
from quillspark.llm.packing import best_fit_pack
from quillspark.llm.simhash import drop_near_copies


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language stay; those without a letter go."""
    return keep_identified(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays, of the largest doc_id."""
    return drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies one row stays, of the least doc_id."""
    return drop_near_copies(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window stay."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of each piece of each document in sequences of 2048 tokens."""
    return best_fit_pack(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_copies),
    ("simhash", near_copies),
    ("decontamination", benchmark_passages),
    ("packing", packing),
]

#: The language model, the fingerprints and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
