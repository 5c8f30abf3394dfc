"""Transaction costs: fixed rates, square-root impact, capacity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CostConfig
from ..functions.numeric import ratio


def fixed_cost(buys: Column, sells: Column, cfg: CostConfig) -> Column:
    return F.lit(cfg.buy_rate) * F.abs(buys) + F.lit(cfg.sell_rate) * F.abs(sells)


def priced(adv: Column) -> Column:
    """A usable average daily value: finite and positive."""
    return F.coalesce((adv > 0) & ~F.isnan(adv) & (adv < F.lit(float("inf"))), F.lit(False))


def impact_bps(value: Column, adv: Column, cfg: CostConfig) -> Column:
    """Basis points of a trade; zero when the daily value is unknown."""
    bps = F.lit(1e4 * cfg.impact_coef) * F.sqrt(F.abs(value) / adv)
    return F.when(priced(adv) & (F.abs(value) > 0), bps).otherwise(F.lit(0.0))


def impact_cost(value: Column, adv: Column, cfg: CostConfig) -> Column:
    return F.abs(value) * impact_bps(value, adv, cfg) / F.lit(1e4)


def trade_costs(
    trades: DataFrame,
    cfg: CostConfig,
    keys: tuple[str, ...] = (),
    value: str = "trade_value",
    adv: str = "adv",
    notional: float = 1.0,
) -> DataFrame:
    """Cost breakdown of a set of signed trades (positive = buy), per key."""
    v = F.coalesce(F.when(~F.isnan(value), F.col(value)), F.lit(0.0))
    sums = trades.groupBy(*keys).agg(
        F.sum(F.greatest(v, F.lit(0.0))).alias("buy_value"),
        F.sum(F.greatest(-v, F.lit(0.0))).alias("sell_value"),
        F.sum(impact_cost(v, F.col(adv), cfg)).alias("impact"),
        F.count(F.when(~priced(F.col(adv)) & (F.abs(v) > 0), 1)).alias("n_missing_adv"),
    )
    fixed = fixed_cost(F.col("buy_value"), F.col("sell_value"), cfg)
    total = fixed + F.col("impact")
    return sums.withColumns({"fixed": fixed, "total": total, "bps": F.lit(1e4) * total / F.lit(notional)})


def break_even_aum(
    gross_annual: Column, turnover: Column, adv: Column, cfg: CostConfig, leverage: float = 1.0
) -> Column:
    """Book size at which impact consumes what fixed costs leave; 0 and infinity are answers."""
    infinite = F.lit(float("inf"))
    left = gross_annual - F.lit((cfg.buy_rate + cfg.sell_rate) / 2.0) * turnover
    if cfg.impact_coef <= 0:
        return F.when((turnover <= 0) | (adv <= 0), infinite).when(left <= 0, F.lit(0.0)).otherwise(infinite)
    root = ratio(left, F.lit(cfg.impact_coef) * turnover)
    return (
        F.when((turnover <= 0) | (adv <= 0), infinite)
        .when(left <= 0, F.lit(0.0))
        .otherwise(root * root * adv / F.lit(max(leverage, 1e-12)))
    )
