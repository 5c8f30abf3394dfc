"""Data-quality checks; each returns one row ``(check, status, n_total, n_bad, fraction)``.

The ``worst`` functions give the offending rows as a top-k report.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import MAX_SESSIONS, broadcast_if_bounded, ratio
from .calendar import rebalance_dates, with_position
from .windows import row_returns

#: Limits of the checks (fixed values).
MAX_MISSING_SESSIONS = 0.02
MAX_NAME_GAP = 0.05
MAX_BAD_NAMES = 0.10
OUTLIER_RETURN = 0.40
MAX_OUTLIER_SHARE = 0.01
MAX_FLOW_GAP = 0.05

_SEVERITY = {"PASS": 0, "WARN": 1, "FAIL": 2}


def verdict(value: Column, limit: float) -> Column:
    """FAIL past the limit, WARN past half of it."""
    return F.when(value > limit, "FAIL").when(value > limit / 2.0, "WARN").otherwise("PASS")


def _result(name: str, df: DataFrame, total: Column, bad: Column, limit: float) -> DataFrame:
    sums = df.agg(total.cast("long").alias("n_total"), bad.cast("long").alias("n_bad"))
    share = ratio(F.col("n_bad").cast("double"), F.col("n_total").cast("double"))
    status = F.when(F.col("n_total") == 0, "FAIL").otherwise(verdict(F.col("fraction"), limit))
    return sums.withColumn("fraction", share).select(
        F.lit(name).alias("check"), status.alias("status"), "n_total", "n_bad", "fraction"
    )


def _absent(sessions: DataFrame, df: DataFrame) -> DataFrame:
    seen = df.select("date").distinct().withColumn("_seen", F.lit(1))
    return sessions.select("date").join(broadcast_if_bounded(seen, MAX_SESSIONS), "date", "left")


def missing_sessions(sessions: DataFrame, df: DataFrame) -> DataFrame:
    """Sessions without any row of ``df``."""
    return _absent(sessions, df).filter(F.col("_seen").isNull()).select("date")


def check_missing_sessions(prices: DataFrame, sessions: DataFrame) -> DataFrame:
    marked = _absent(sessions, prices)
    return _result(
        "missing_trading_days", marked, F.count(F.lit(1)), F.count(F.when(F.col("_seen").isNull(), 1)),
        MAX_MISSING_SESSIONS,
    )


def check_series_gaps(flows: DataFrame, sessions: DataFrame, label: str = "flows_daily") -> DataFrame:
    marked = _absent(sessions, flows)
    return _result(
        f"{label}_gaps", marked, F.count(F.lit(1)), F.count(F.when(F.col("_seen").isNull(), 1)), MAX_FLOW_GAP
    )


def name_gaps(prices: DataFrame, sessions: DataFrame) -> DataFrame:
    """Per symbol: sessions of its own span, rows, and the fraction missing inside."""
    spans = with_position(prices.select("date", "symbol"), sessions).groupBy("symbol").agg(
        (F.max("pos") - F.min("pos") + 1).cast("long").alias("span_sessions"), F.count(F.lit(1)).alias("n_rows")
    )
    gap = F.greatest(F.lit(0), F.col("span_sessions") - F.col("n_rows"))
    return spans.withColumn("gap_fraction", gap / F.col("span_sessions"))


def check_name_coverage(prices: DataFrame, sessions: DataFrame) -> DataFrame:
    return _result(
        "per_stock_coverage",
        name_gaps(prices, sessions),
        F.count(F.lit(1)),
        F.count(F.when(F.col("gap_fraction") > MAX_NAME_GAP, 1)),
        MAX_BAD_NAMES,
    )


def worst_names(prices: DataFrame, sessions: DataFrame, k: int = 10) -> DataFrame:
    bad = name_gaps(prices, sessions).filter(F.col("gap_fraction") > MAX_NAME_GAP)
    return bad.orderBy(F.col("gap_fraction").desc(), "symbol").limit(k)


def check_return_outliers(prices: DataFrame) -> DataFrame:
    returns = row_returns(prices).filter(F.col("ret").isNotNull())
    return _result(
        "return_outliers",
        returns,
        F.count(F.lit(1)),
        F.count(F.when(F.abs("ret") > OUTLIER_RETURN, 1)),
        MAX_OUTLIER_SHARE,
    )


def worst_returns(prices: DataFrame, k: int = 10) -> DataFrame:
    big = row_returns(prices).filter(F.abs("ret") > OUTLIER_RETURN)
    return big.orderBy(F.abs("ret").desc(), "date", "symbol").limit(k)


def universe_cardinality(
    prices: DataFrame, sessions: DataFrame, *, min_history: int = 60, size: int | None = None, freq: str = "quarterly"
) -> DataFrame:
    """``(rebalance_date, n_members)``: names with enough history as of each rebalance.

    ``size`` caps the count where a universe is declared to hold so many names; by default none is.

    A name becomes eligible on its ``min_history``-th row and stays eligible, so one date
    per name and a running count over the sessions replace a rescan per rebalance. The
    reference rule also asks for a last close, which the canonical panel guarantees.
    """
    nth = F.row_number().over(Window.partitionBy("symbol").orderBy("date"))
    starts = (
        prices.filter(F.col("close").isNotNull())
        .select("date", "symbol")
        .withColumn("_i", nth)
        .filter(F.col("_i") == min_history)
        .groupBy("date")
        .agg(F.count(F.lit(1)).alias("_new"))
    )
    running = F.sum(F.coalesce("_new", F.lit(0))).over(
        Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    )
    grown = sessions.join(broadcast_if_bounded(starts, MAX_SESSIONS), "date", "left").select(
        F.col("date").alias("rebalance_date"), (running if size is None else F.least(running, F.lit(size))).cast("long").alias("n_members")
    )
    return grown.join(broadcast_if_bounded(rebalance_dates(sessions, freq), MAX_SESSIONS), "rebalance_date", "left_semi")


def check_universe(
    prices: DataFrame, sessions: DataFrame, band: tuple[int, int] = (350, 600), **rule
) -> DataFrame:
    """Median membership against the band; endpoints outside it are a warning."""
    lo, hi = band
    members = universe_cardinality(prices, sessions, **rule)
    sums = members.agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count(F.when(~F.col("n_members").between(lo, hi), 1)).alias("n_bad"),
        F.expr("percentile(n_members, 0.5)").alias("_median"),
        F.min_by("n_members", "rebalance_date").alias("_first"),
        F.max_by("n_members", "rebalance_date").alias("_last"),
    )
    inside = F.col("_median").between(lo, hi)
    edges = (F.col("_first") < lo) | (F.col("_last") > hi)
    status = F.when((F.col("n_total") == 0) | ~inside, "FAIL").when(edges, "WARN").otherwise("PASS")
    return sums.select(
        F.lit("universe_cardinality").alias("check"),
        status.alias("status"),
        "n_total",
        "n_bad",
        ratio(F.col("n_bad").cast("double"), F.col("n_total").cast("double")).alias("fraction"),
    )


def check_adjustment(prices: DataFrame) -> DataFrame:
    """Any missing or non-positive adjustment factor, or missing adjusted close, fails."""
    usable = (F.col("adj_factor") > 0) & (F.col("adj_factor") < F.lit(float("inf"))) & ~F.isnan("adj_factor")
    bad = ~F.coalesce(usable, F.lit(False)) | F.col("adj_close").isNull()
    out = _result("adjustment_sanity", prices, F.count(F.lit(1)), F.count(F.when(bad, 1)), 0.0)
    return out.withColumn("status", F.when((F.col("n_total") == 0) | (F.col("n_bad") > 0), "FAIL").otherwise("PASS"))


def run_checks(
    prices: DataFrame,
    sessions: DataFrame,
    *,
    flows: DataFrame | None = None,
    band: tuple[int, int] = (350, 600),
    extra: Sequence[DataFrame] = (),
    **rule,
) -> DataFrame:
    """Every check as one result table."""
    parts = [
        check_missing_sessions(prices, sessions),
        check_name_coverage(prices, sessions),
        check_return_outliers(prices),
        *([check_series_gaps(flows, sessions)] if flows is not None else []),
        check_universe(prices, sessions, band, **rule),
        check_adjustment(prices),
        *extra,
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def overall_status(results: DataFrame) -> DataFrame:
    """FAIL beats WARN beats PASS."""
    rank = F.create_map(*[F.lit(x) for kv in _SEVERITY.items() for x in kv])
    return results.agg(
        F.max_by("status", rank[F.col("status")]).alias("status"), F.count(F.lit(1)).alias("n_checks")
    )
