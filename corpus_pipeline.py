"""The corpus pipeline: from raw documents to packed training sequences.

Every stage applies one operator to all that the stage before kept, is written as Parquet and read again.
All stages but the last return the columns of ``documents``. A stage takes NULL texts, repeated rows, empty
tables and further columns as its operator defines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from netloom.llm import common, content_sort, decontaminate, language, packing, simhash
from netloom.llm.registry import vocabulary
from netloom.session import stage


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages of the labels; texts without a letter, and long ones that are close to no language, go."""
    return language.accepted_documents(docs, least_score=0.08)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, the one with the largest doc_id stays."""
    return content_sort.distinct_documents(docs, keep="max")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints are linked, the one with the smallest doc_id stays. Shingle length and distance are the operator's."""
    return simhash.one_of_each(docs, radius=3, width=3, seed=42)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words in a row of a benchmark item, or all of a shorter item, go."""
    return decontaminate.clean_documents(docs, common.table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents and their place in sequences of 2048 tokens."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"), capacity=2048)


STAGES = [
    ("language ID", known_language),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", best_fit_packing),
]

# Language prototypes and tokenizers are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
