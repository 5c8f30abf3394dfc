"""Logical panel tables derived from the order/line-item star schema.

==============  ==========================================================================
``prices``      week x supplier bars from line items (weighted price, range, volume)
``flows``       week x order priority as participant long/short positions
``sectors``     supplier -> region name
``shares``      supplier -> account balance where positive, as a share count
==============  ==========================================================================

Line items are reduced by week and supplier with map-side partial aggregation before the
one shuffle, so a supplier holding a third of all rows still contributes at most one
partial row per week and task. Money is summed as whole cents: integer sums do not depend
on the order of rows, so ranks built on them repeat exactly after a retried task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Order priority -> participant; the last one plays the summary row ingestion drops.
PARTICIPANT_OF_PRIORITY = {
    "1-URGENT": "FII",
    "2-HIGH": "DII",
    "3-MEDIUM": "Client",
    "4-NOT SPECIFIED": "Pro",
    "5-LOW": "TOTAL",
}

#: Length of the symbol prefix used as coarse tie code (leaves 1 000 ids per code).
SYMBOL_CODE_LENGTH = 10


def symbol_code(symbol: str = "symbol") -> Column:
    return F.substring(F.col(symbol), 1, SYMBOL_CODE_LENGTH)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def week_of(ts: str) -> Column:
    """Monday of the week, by integer day arithmetic."""
    day = F.col(ts).cast("date")
    return F.date_sub(day, F.weekday(day))


def symbol_of(key: str) -> Column:
    digits = F.col(key).cast("string")  # padded where short, never cut
    return F.concat(F.lit("S"), F.repeat(F.lit("0"), F.greatest(F.lit(0), 12 - F.length(digits))), digits)


def hundredths(c: str) -> Column:
    """A non-negative amount as whole hundredths."""
    return F.floor(F.col(c) * F.lit(100.0) + F.lit(0.5))


def raw_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``date, symbol, open, high, low, close, adj_close, volume, delivery_pct``."""
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    lines = read(spark, sf_dir, "lineitem").select(
        week_of("l_shipdate").alias("date"),
        "l_suppkey",
        F.col("l_quantity").cast("long").alias("_qty"),
        hundredths("l_extendedprice").alias("_cents"),
        hundredths("l_discount").alias("_points"),
        unit.alias("unit"),
        (F.col("l_returnflag") == "N").cast("int").alias("_kept"),
    )
    rows = F.count(F.lit(1)).cast("double")
    bars = lines.groupBy("date", "l_suppkey").agg(
        (F.sum("_cents").cast("double") / (F.sum("_qty") * F.lit(100.0))).alias("close"),
        (F.sum("_points").cast("double") / (rows * F.lit(100.0))).alias("_discount"),
        F.max("unit").alias("high"),
        F.min("unit").alias("low"),
        F.sum("_qty").cast("double").alias("volume"),
        F.floor(F.sum("_kept") * 100 / F.count(F.lit(1))).cast("double").alias("delivery_pct"),
    )
    return bars.select(
        "date",
        symbol_of("l_suppkey").alias("symbol"),
        F.col("close").alias("open"),
        "high",
        "low",
        "close",
        (F.col("close") * (F.lit(1.0) - F.col("_discount"))).alias("adj_close"),
        "volume",
        "delivery_pct",
    )


def participant_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``date, participant, long, short`` from order totals (open orders count as short)."""
    mapping = F.create_map(*[F.lit(x) for kv in PARTICIPANT_OF_PRIORITY.items() for x in kv])
    open_order = F.col("o_orderstatus") == "O"
    cents = read(spark, sf_dir, "orders").select(
        week_of("o_orderdate").alias("date"),
        mapping[F.col("o_orderpriority")].alias("participant"),
        F.when(~open_order, hundredths("o_totalprice")).otherwise(F.lit(0)).alias("_long"),
        F.when(open_order, hundredths("o_totalprice")).otherwise(F.lit(0)).alias("_short"),
    )
    return cents.groupBy("date", "participant").agg(
        (F.sum("_long") / F.lit(100.0)).alias("long"),
        (F.sum("_short") / F.lit(100.0)).alias("short"),
        ((F.sum("_long") - F.sum("_short")) / F.lit(100.0)).alias("net"),
    )


def participant_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Participant panel without the summary row, with net futures."""
    return (
        participant_positions(spark, sf_dir)
        .filter(F.col("participant") != "TOTAL")
        .select(
            "date",
            "participant",
            F.col("long").alias("fut_index_long"),
            F.col("short").alias("fut_index_short"),
            F.lit(0.0).alias("fut_stock_long"),
            F.lit(0.0).alias("fut_stock_short"),
            F.col("net").alias("net_futures"),
        )
    )


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = read(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return (
        supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(symbol_of("s_suppkey").alias("symbol"), F.col("r_name").alias("sector"))
    )


def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        read(spark, sf_dir, "supplier")
        .filter(F.col("s_acctbal") > 0)
        .select(symbol_of("s_suppkey").alias("symbol"), F.col("s_acctbal").alias("shares"))
    )


def ship_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session dimension from the ship weeks: a one-column scan, not the whole panel."""
    from ..operators.calendar import sessions_from

    return sessions_from(read(spark, sf_dir, "lineitem").select(week_of("l_shipdate").alias("date")))
