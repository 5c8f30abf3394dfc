"""Price-panel normalisation, session densification and reshaping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import MAX_SESSIONS, broadcast_if_bounded, finite

PRICE_COLUMNS = (
    "open", "high", "low", "close", "adj_close", "volume",
    "adj_factor", "adj_open", "adj_high", "adj_low", "turnover", "delivery_pct",
)
INSTITUTIONS = ("FII", "DII")


def canonical_prices(raw: DataFrame, *, require_adj_close: bool = True) -> DataFrame:
    """Typed OHLCV panel with adjusted bars and turnover; unusable rows are dropped."""
    needed = ["date", "symbol", "open", "high", "low", "close", "volume"]
    missing = [c for c in needed if c not in raw.columns]
    if require_adj_close and "adj_close" not in raw.columns:
        missing.append("adj_close")
    if missing:
        raise ValueError(f"price panel is missing columns {missing}")
    adj = F.col("adj_close") if "adj_close" in raw.columns else F.col("close")
    delivery = F.col("delivery_pct") if "delivery_pct" in raw.columns else F.lit(None)
    extra = [c for c in raw.columns if c not in {*needed, "adj_close", "delivery_pct"}]
    typed = raw.select(
        F.col("date").cast("date").alias("date"),
        F.trim(F.col("symbol").cast("string")).alias("symbol"),
        *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")],
        adj.cast("double").alias("adj_close"),
        F.col("volume").cast("double").alias("volume"),
        delivery.cast("double").alias("delivery_pct"),
        *extra,
    )
    kept = typed.filter(
        F.col("date").isNotNull()
        & (F.col("symbol") != "")
        & (F.col("close") > 0)
        & F.col("adj_close").isNotNull()
    )
    factor = F.col("adj_close") / F.col("close")
    return kept.withColumns(
        {
            "adj_factor": factor,
            "adj_open": F.col("open") * factor,
            "adj_high": F.col("high") * factor,
            "adj_low": F.col("low") * factor,
            "turnover": F.col("close") * F.col("volume"),
        }
    )


def finalise(df: DataFrame, order: Sequence[Column] | None = None) -> DataFrame:
    """Fill absent canonical columns and keep the last row of each (date, symbol).

    Spark rows carry no file order, so "last" follows the explicit ``order`` columns.
    Pass ``order=None`` when the key is already unique and no shuffle is wanted.
    """
    if order is not None:
        w = Window.partitionBy("date", "symbol").orderBy(*[c.desc() for c in order])
        df = df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    have = set(df.columns)
    filled = df.withColumns({c: F.lit(None).cast("double") for c in PRICE_COLUMNS if c not in have})
    factor = F.coalesce("adj_factor", F.lit(1.0))
    return filled.select(
        "date",
        "symbol",
        *[
            (
                factor
                if c == "adj_factor"
                else F.coalesce(c, F.col(c.removeprefix("adj_")) * factor)
                if c in ("adj_open", "adj_high", "adj_low")
                else F.col(c)
            ).cast("double").alias(c)
            for c in PRICE_COLUMNS
        ],
    )


def last_position(sessions: DataFrame) -> Column:
    """Ordinal of the last session as a scalar subquery."""
    return sessions.agg(F.max("pos")).scalar()


def fill_sessions(
    df: DataFrame,
    sessions: DataFrame,
    keys: Sequence[str],
    *,
    reach: int | None = None,
) -> DataFrame:
    """Add rows for sessions a key did not observe, with NULL in every other column.

    ``df`` carries ``pos``, unique per key. Each observed row emits itself and the empty
    sessions up to the key's next observation, but no further than ``reach`` sessions
    ahead (``None`` = to the end of the calendar), so no session x key product is formed.
    """
    others = [c for c in df.columns if c not in {*keys, "pos"}]
    w = Window.partitionBy(*keys).orderBy("pos")
    end = last_position(sessions)
    horizon = F.least(F.coalesce(F.lead("pos").over(w) - 1, end), end)
    if reach is not None:
        horizon = F.least(horizon, F.col("pos") + reach)
    spread = (
        df.withColumn("_last", horizon)
        .withColumn("_at", F.explode(F.sequence("pos", F.greatest("_last", "pos"))))
    )
    return spread.select(
        *keys,
        F.col("_at").alias("pos"),
        *[F.when(F.col("_at") == F.col("pos"), F.col(c)).alias(c) for c in others],
    )


def dense_grid(df: DataFrame, sessions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every session of the calendar for every key, NULL where nothing was observed."""
    others = [c for c in df.columns if c not in {*keys, "pos"}]
    w = Window.partitionBy(*keys).orderBy("pos")
    start = F.when(F.lag("pos").over(w).isNull(), F.lit(0)).otherwise(F.col("pos"))
    stop = F.coalesce(F.lead("pos").over(w) - 1, last_position(sessions))
    spread = df.withColumns({"_a": start, "_b": stop})
    return spread.withColumn("_at", F.explode(F.sequence("_a", "_b"))).select(
        *keys,
        F.col("_at").alias("pos"),
        *[F.when(F.col("_at") == F.col("pos"), F.col(c)).alias(c) for c in others],
    )


def with_dates(df: DataFrame, sessions: DataFrame) -> DataFrame:
    """Replace nothing, add ``date`` from ``pos``."""
    return df.join(broadcast_if_bounded(sessions.select("pos", "date"), MAX_SESSIONS), "pos")


def to_long(df: DataFrame, value: str = "value") -> DataFrame:
    """Typed long panel without missing or non-finite values."""
    return df.select("date", "symbol", finite(value).alias("value")).filter(F.col("value").isNotNull())


def to_wide(df: DataFrame, names: Sequence[str], on: str = "symbol", value: str = "value") -> DataFrame:
    """Date x name table for an explicit, bounded list of names; the first value wins."""
    return df.groupBy("date").pivot(on, list(names)).agg(F.first(value, ignorenulls=True))


def stack(panels: dict[str, DataFrame]) -> DataFrame:
    """Named panels as one ``(date, symbol, factor, value)`` frame."""
    parts = [p.select("date", "symbol", F.lit(n).alias("factor"), "value") for n, p in panels.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def weight_history(weights: DataFrame, factors: Sequence[str]) -> DataFrame:
    """Date x factor weights with zero where a factor carried none."""
    return weights.groupBy("date").pivot("factor", list(factors)).agg(F.first("weight")).fillna(0.0)


def institutional_flows(participants: DataFrame) -> DataFrame:
    """Institutional participants with gross long and short futures legs."""
    return participants.filter(F.col("participant").isin(*INSTITUTIONS)).select(
        "date",
        "participant",
        "net_futures",
        (F.col("fut_index_long") + F.col("fut_stock_long")).alias("gross_futures_long"),
        (F.col("fut_index_short") + F.col("fut_stock_short")).alias("gross_futures_short"),
    )


def align_to_sessions(
    df: DataFrame, sessions: DataFrame, participant: str, value: str = "net_futures"
) -> DataFrame:
    """One participant's series on the session grid, NULL (never zero) where absent."""
    one = df.filter(F.col("participant") == participant).select("date", F.col(value).alias("value"))
    return sessions.join(one, "date", "left")
