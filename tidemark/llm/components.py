"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stage


def _halves(edges: DataFrame) -> DataFrame:
    """Both directions of every edge."""
    return edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Point neighbours at the smallest node around ``a``: those above ``a``, or those below and ``a``.

    The minimum is a partial aggregate joined back, so that a hub with very many neighbours is never
    gathered in one task.
    """
    if large:
        around = _halves(edges)
        least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        return around.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    around = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = around.groupBy("a").agg(F.min("b").alias("m"))
    moved = around.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, purpose: str = "components") -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node of ``edges`` (a, b).

    Each round is written to the shared folder; the loop ends when a round changes nothing, which its
    row count and hash sum tell.
    """
    current = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), purpose)
    seen = None
    while True:
        current = stage(_stars(_stars(current, large=True), large=False), purpose)
        row = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (row["n"], row["h"]) == seen:
            break
        seen = (row["n"], row["h"])
    hubs = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(hubs)
