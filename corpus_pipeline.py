"""The corpus pipeline: stages over ``documents``, each written as Parquet and read by the next.

Every stage takes what its operator's module states for nulls, empty and very long texts, ties, repeated
rows, empty tables and other columns; all but the last return the columns that they were given.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import kneser, mixing, packing, rules, simhash
from tidemark.llm.common import release, stage, staged
from tidemark.llm.registry import table
from tidemark.llm.tokens import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity stays within the limit of their language."""
    return kneser.keep(docs, kneser.trusted_labels(table(spark, sf_dir, "labels")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the current policy of the rule ledger."""
    judged = rules.apply_policy(rules.ledger(docs), rules.POLICIES[rules.CURRENT])
    return judged.where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group."""
    return simhash.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, once per pass over its source."""
    return mixing.mixed(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of the mix in sequences of 1024 tokens."""
    return packing.pack(docs, tokenizer_path(packing.VOCABULARY))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_duplicates),
    ("source mix", source_mix),
    ("best-fit packing", best_fit_packing),
]

#: Perplexities and fingerprints are not SQL; tests/llm check subsets and the bound of 1024 tokens.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs, mark = table(spark, sf_dir, "documents"), staged()
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
        release(mark, keep=1)  # nothing reads what led to a stage once it is written
    return docs
