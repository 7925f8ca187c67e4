"""The corpus pipeline: stages of the training-data operators, each over all that its predecessor kept.

All stages but the last return the columns of `documents`; the last returns the pieces of packed
sequences.  Rejected documents are gone for all later stages.

Defined results: null and empty texts, and those of fewer than 20 words, go in the first stage.  A row without an id
is judged like any other and is a group of its own among near duplicates.  Of repeated rows (one id, one text) one stays
after near-dedup.  All columns of the table, whatever their names, pass through unchanged up to packing, which
returns its own.  Empty tables pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattica.llm import decontamination, near_dedup, packing, quality_rules, toxicity
from lattica.llm.common import materialise, table
from lattica.llm.queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the isolation forest."""
    return quality_rules.keep_good(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't call toxic."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more)."""
    return near_dedup.keep_one(docs, shingle=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in packed sequences of at most 4096 tokens."""
    return packing.pack(docs, tokenizer_path(), memory_words=200_000)


STAGES = [
    ("quality rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("near-dedup", dedup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]
#: The stages train models and tokenize, which SQL can't express; tests/llm hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
