"""Queries of the corpus operators and, where SQL can state them, their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_all() -> None:
    """Import the modules that register queries."""
    from tidemark.llm import (  # noqa: F401
        ann,
        curve,
        dac,
        importance,
        kneser,
        licenses,
        mixing,
        packing,
        rules,
        simhash,
        toxicity,
        variants,
        warc,
    )
