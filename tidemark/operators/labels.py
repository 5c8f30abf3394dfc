"""Forward-return labels and per-date rank information coefficients."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import MAX_SESSIONS, broadcast_if_bounded, ratio
from ..functions.ranking import GROUP_LIMIT, average_rank_over, average_rank_table, by_size
from ..session import stage
from .calendar import with_position
from .windows import ahead


def forward_returns(
    prices: DataFrame, sessions: DataFrame, horizons: Sequence[int], price: str = "adj_close"
) -> DataFrame:
    """``(date, symbol, pos, fwd_h...)`` by entry date; NULL across gaps and past the end."""
    if any(h <= 0 for h in horizons):
        raise ValueError("forward-return horizons must be positive")
    if price not in prices.columns:
        raise ValueError(f"prices has no column {price!r}")
    seen = with_position(prices.select("date", "symbol", price), sessions).filter(F.col(price).isNotNull())
    labels = [forward_return(h, price).alias(f"fwd_{h}") for h in horizons]
    return seen.select("date", "symbol", "pos", *labels)


def forward_return(horizon: int, price: str = "adj_close") -> Column:
    """The return to ``horizon`` sessions ahead, over rows by ``symbol`` and ``pos``."""
    return ratio(ahead(price, horizon), F.col(price)) - 1


def horizon_long(labels: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """Labels as ``(date, symbol, horizon, ret)`` with a defined return."""
    pairs = F.array(
        *[F.struct(F.lit(h).alias("horizon"), F.col(f"fwd_{h}").alias("ret")) for h in horizons]
    )
    return labels.select("date", "symbol", F.inline(pairs)).filter(F.col("ret").isNotNull())


def rank_ic(
    panel: DataFrame,
    labels: DataFrame,
    *,
    series: Sequence[str] = (),
    min_names: int = 10,
    value: str = "value",
    group_limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Spearman correlation per date: Pearson correlation of average ranks.

    Cross-sections of up to ``group_limit`` names are ranked by one task each, larger ones by value buckets.

    ``panel`` carries ``date, symbol, value`` plus the ``series`` columns found on it;
    ``labels`` carries ``date, symbol, ret`` and possibly ``horizon``. Dates with fewer than
    ``min_names`` joint observations are dropped; a constant cross-section gives a NULL
    coefficient that still counts its names.
    """
    own = [c for c in series if c in panel.columns]
    shared = [c for c in series if c in labels.columns and c not in own]
    joint = (
        panel.filter(F.col(value).isNotNull())
        .select("date", "symbol", *own, F.col(value).alias("_x"))
        .join(labels.select("date", "symbol", *shared, F.col("ret").alias("_y")), ["date", "symbol"])
        .filter(F.col("_y").isNotNull())
    )
    return joint_ic(joint, [*own, *shared, "date"], min_names, group_limit)


def joint_ic(joint: DataFrame, by: Sequence[str], min_names: int, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """``(by, ic, n)`` of rows that carry both values, ``_x`` and ``_y``."""
    joint = stage(joint.select(*by, "_x", "_y"), "ic")
    light, heavy = by_size(joint, by, group_limit)
    # One shuffle: both ranks and the sums below share the partitioning by group.
    ranked = light.withColumns({"_rx": average_rank_over(by, "_x"), "_ry": average_rank_over(by, "_y")})
    ic = _rank_correlation(ranked, by, min_names)
    if heavy is None:
        return ic
    spread = heavy.join(average_rank_table(heavy, by, "_x", "_rx"), [*by, "_x"]).join(
        average_rank_table(heavy, by, "_y", "_ry"), [*by, "_y"]
    )
    return ic.unionByName(_rank_correlation(spread, by, min_names))


def _rank_correlation(ranked: DataFrame, by: Sequence[str], min_names: int) -> DataFrame:
    return (
        ranked.groupBy(*by)
        .agg(
            ratio(F.covar_pop("_rx", "_ry"), F.stddev_pop("_rx") * F.stddev_pop("_ry")).alias("ic"),
            F.count(F.lit(1)).alias("n"),
        )
        .filter(F.col("n") >= min_names)
    )


def usable_from(ic: DataFrame, sessions: DataFrame, horizon: int | str = "horizon") -> DataFrame:
    """Add ``pos`` and the first session on which the label had been realised (NULL = never)."""
    h = F.col(horizon) if isinstance(horizon, str) else F.lit(horizon)
    later = broadcast_if_bounded(
        sessions.select(F.col("pos").alias("_due"), F.col("date").alias("usable_from")), MAX_SESSIONS
    )
    return (
        with_position(ic, sessions).withColumn("_due", (F.col("pos") + h).cast("int")).join(later, "_due", "left")
    ).drop("_due")
