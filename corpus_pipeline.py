"""A corpus pipeline of the operators: each stage works on what the one before has kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's `docs`. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from candlewick.llm.common import store, table
from candlewick.llm.decontamination import decontaminated
from candlewick.llm.jaccard_join import one_of_each
from candlewick.llm.packing import packed
from candlewick.llm.quality_rules import passing
from candlewick.llm.suffix_dedup import without_repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf: str) -> DataFrame:
    """Documents that pass every rule of the standard policy."""
    return passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf: str) -> DataFrame:
    """One document of each group connected by a similarity of 0.8 or more on shingles of five words."""
    return one_of_each(docs, size=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf: str) -> DataFrame:
    """Documents without the passages of 200 bytes or more that occur anywhere else."""
    return without_repeats(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminated(docs, table(spark, sf, "benchmark", "item_id", "text"))


def packing(spark: SparkSession, docs: DataFrame, sf: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 1024 tokens."""
    return packed(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", packing),
]

# links, repeated strings and packing have no SQL; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = store(stage(spark, docs, sf), f"pipeline-{number}")
    return docs
