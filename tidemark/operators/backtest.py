"""Overlapping-sleeve long/short backtest in closed form.

``holding`` sleeves each own ``1/holding`` of the gross and are reset in turn. At session
``i`` only one sleeve changes, so with ``w_i = weight_i * scale_i / holding``

* the book is the sum of ``w`` over the last ``holding`` sessions, and
* the trade is ``w_i - w_(i - holding)``,

both plain RANGE windows per name. Nothing loops over sessions, and per-name work stays
partitioned by (strategy, symbol).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import TRADING_DAYS, BookConfig, CostConfig
from ..functions.numeric import MAX_SESSIONS, broadcast_if_bounded, ratio
from ..session import stage
from . import windows as W
from .calendar import with_position
from .costs import priced
from .crosssection import tail_weights
from .panel import dense_grid, fill_sessions, last_position
from .sharpe import sharpe_from

FLAT = 1e-12


def target_weights(
    panel: DataFrame,
    sessions: DataFrame,
    cfg: BookConfig,
    *,
    keys: Sequence[str] = ("strategy",),
    n_series: int | None = None,
    tie_code: Column | None = None,
) -> DataFrame:
    """``(keys, symbol, pos, weight)`` of every session's long and short tails.

    The selection reads ``panel`` several times: pass a staged one.
    """
    bound = None if n_series is None else MAX_SESSIONS * n_series
    signal = with_position(panel.select(*keys, "date", "symbol", "value"), sessions).filter(
        F.col("value").isNotNull()
    )
    tails = tail_weights(
        signal,
        by=[*keys, "date", "pos"],
        n_quantiles=cfg.n_quantiles,
        leverage=cfg.leverage,
        long_only=cfg.long_only,
        tie_code=tie_code,
        max_groups=bound,
    )
    return tails.select(*keys, "symbol", "pos", "weight")


def market_steps(prices: DataFrame, sessions: DataFrame, adv_window: int) -> DataFrame:
    """Per name and session: return to the next session and trailing daily value."""
    seen = with_position(prices.select("date", "symbol", "adj_close", "turnover"), sessions)
    step = ratio(W.ahead("adj_close", 1), F.col("adj_close")) - 1
    return seen.select("symbol", "pos", step.alias("step"), W.adv(adv_window).alias("adv"))


def aged_weights(
    targets: DataFrame, sessions: DataFrame, holding: int, keys: Sequence[str] = ("strategy",)
) -> DataFrame:
    """``(keys, symbol, pos, w0 .. w<holding>)``: a sleeve's share of the target set that many sessions ago, else NULL.

    A name has a row for every session up to ``holding`` after a target, so the target of ``k`` sessions ago, if
    there is one, stands exactly ``k`` rows back.
    """
    own = [*keys, "symbol"]
    sized = targets.select(*own, "pos", (F.col("weight") / F.lit(holding)).alias("w0")).repartition("symbol")
    spread = fill_sessions(sized, sessions, own, reach=holding).filter(F.col("pos") < last_position(sessions))
    back = W.by_session(*own)
    older = [
        F.when(F.lag("pos", k).over(back) == F.col("pos") - k, F.lag("w0", k).over(back)).alias(f"w{k}")
        for k in range(1, holding + 1)
    ]
    return spread.select(*own, "pos", "w0", *older)


def _amounts(holding: int) -> list[Column]:
    """``book, unit_book, delta`` from aged weights and, if there are any, the scales ``s0 ..`` they were set under."""

    def sized(k: int, scaled: bool) -> Column:
        weight = F.col(f"w{k}") * F.col(f"s{k}") if scaled else F.col(f"w{k}")
        return F.coalesce(weight, F.lit(0.0))

    def total(scaled: bool) -> Column:
        out = sized(holding - 1, scaled)
        for k in range(holding - 2, -1, -1):
            out = out + sized(k, scaled)
        return out

    return [total(True).alias("book"), total(False).alias("unit_book"), (sized(0, True) - sized(holding, True)).alias("delta")]


def unscaled(aged: DataFrame, holding: int) -> DataFrame:
    """Aged weights without an overlay."""
    return aged.withColumns({f"s{k}": F.lit(1.0) for k in range(holding + 1)})


def sleeve_positions(
    targets: DataFrame, sessions: DataFrame, holding: int, keys: Sequence[str] = ("strategy",)
) -> DataFrame:
    """``(keys, symbol, pos, book, unit_book, delta)`` for every session a name is held or traded."""
    aged = unscaled(aged_weights(targets, sessions, holding, keys), holding)
    return aged.select(*keys, "symbol", "pos", *_amounts(holding))


def priced_weights(
    targets: DataFrame, sessions: DataFrame, market: DataFrame, holding: int, keys: Sequence[str] = ("strategy",)
) -> DataFrame:
    """``(keys, pos, w0 .., step, adv)``: aged weights next to their name's market.

    All that overlays of any number need of the names, whatever multiples they apply, as these are the same for
    all names of a session. Both sides lie by name, a name's market as one array over the calendar, so only the
    targets are moved.
    """
    at = F.sort_array(F.collect_list(F.struct("pos", "step", "adv")))
    by_name = dense_grid(market, sessions, ["symbol"]).groupBy("symbol").agg(at.alias("_market"))
    aged = aged_weights(targets, sessions, holding, keys).join(by_name.hint("shuffle_hash"), "symbol", "left")
    today = F.get("_market", F.col("pos"))
    return aged.withColumns({"step": today["step"], "adv": today["adv"]}).drop("symbol", "_market")


def scaled_weights(
    weights: DataFrame, scales: DataFrame, holding: int, keys: Sequence[str] = ("strategy",), max_rows: int | None = None
) -> DataFrame:
    """``priced_weights`` with the multiples ``s0 ..`` under which each was set, once per variant of ``scales``.

    ``scales`` has ``keys, pos, scale`` for every session and may have a ``variant``. It is as small as the calendar;
    variants part from each other inside a task, behind the last shuffle of the names.
    """
    own = [c for c in ("variant", *keys) if c in scales.columns]
    back = W.by_session(*own)
    aged = scales.select(
        *own, "pos", *[(F.col("scale") if k == 0 else F.lag("scale", k).over(back)).alias(f"s{k}") for k in range(holding + 1)]
    )
    if "variant" not in scales.columns:
        return weights.join(broadcast_if_bounded(aged, max_rows), [*keys, "pos"])
    each = [c for c in aged.columns if c not in {*keys, "pos"}]
    packed = aged.groupBy(*keys, "pos").agg(F.collect_list(F.struct(*each)).alias("_each"))
    met = weights.join(broadcast_if_bounded(packed, max_rows), [*keys, "pos"])
    return met.select(*weights.columns, F.inline("_each"))


def session_spine(sessions: DataFrame, names: DataFrame) -> DataFrame:
    """Every tradable session of every strategy.

    ``names`` holds one row per strategy; its sessions come from a generated sequence, so
    the spine needs no join.
    """
    return names.withColumn("pos", F.explode(F.sequence(F.lit(0), last_position(sessions) - 1)))


def daily_sums(positions: DataFrame, cfg: CostConfig, keys: Sequence[str]) -> DataFrame:
    """Per strategy and session of priced positions: returns, trades, unit impact, counts."""
    size = F.abs("delta")
    trades = size > 0
    known = priced(F.col("adv"))
    held = F.abs("book") > FLAT
    no_price = held & F.col("step").isNull()
    return positions.groupBy(*keys, "pos").agg(
        F.sum(F.coalesce(F.col("book") * F.col("step"), F.lit(0.0))).alias("gross_return"),
        F.sum(F.coalesce(F.col("unit_book") * F.col("step"), F.lit(0.0))).alias("unit_return"),
        F.sum(size).alias("turnover"),
        F.sum(F.greatest("delta", F.lit(0.0))).alias("buys"),
        F.sum(F.greatest(-F.col("delta"), F.lit(0.0))).alias("sells"),
        F.sum(
            F.when(trades & known, size * F.lit(cfg.impact_coef) * F.sqrt(size / F.col("adv"))).otherwise(0.0)
        ).alias("impact_unit"),
        F.count(F.when(trades & ~known, 1)).alias("missing_adv"),
        F.count(F.when(F.col("book") > FLAT, 1)).alias("n_long"),
        F.count(F.when(F.col("book") < -FLAT, 1)).alias("n_short"),
        F.count(F.when(no_price, 1)).alias("unpriced_days"),
        F.sum(F.when(no_price, F.abs("book")).otherwise(0.0)).alias("unpriced_gross"),
    )


_AMOUNTS = ("gross_return", "unit_return", "turnover", "buys", "sells", "impact_unit", "unpriced_gross")
_COUNTS = ("missing_adv", "n_long", "n_short", "unpriced_days")


def run_backtest(
    targets: DataFrame,
    prices: DataFrame,
    sessions: DataFrame,
    cfg: BookConfig,
    *,
    keys: Sequence[str] = ("strategy",),
    names: DataFrame | None = None,
    market: DataFrame | None = None,
) -> DataFrame:
    """Daily results per strategy, dated on the session the return is earned.

    Impact is kept per unit of book size: relative impact grows with the square root of the
    notional, so every book size is priced from the same pass (:func:`at_notional`).
    """
    market = market_steps(prices, sessions, cfg.costs.adv_window) if market is None else market
    if names is None:
        targets = stage(targets, "targets")  # read for the names of strategies and for their weights
        names = targets.select(*keys).distinct()
    weights = priced_weights(targets, sessions, market, cfg.holding, keys)
    return daily_results(unscaled(weights, cfg.holding), sessions, cfg, names, keys)


def daily_results(
    weights: DataFrame, sessions: DataFrame, cfg: BookConfig, names: DataFrame, keys: Sequence[str] = ("strategy",)
) -> DataFrame:
    """:func:`run_backtest` from priced weights and the multiples they were set under."""
    positions = weights.select(*keys, "pos", "step", "adv", *_amounts(cfg.holding))
    filled = session_spine(sessions, names).join(daily_sums(positions, cfg.costs, keys), [*keys, "pos"], "left")
    filled = filled.fillna(0.0, list(_AMOUNTS)).fillna(0, list(_COUNTS))
    dated = broadcast_if_bounded(
        sessions.select((F.col("pos") - 1).alias("pos"), F.col("date")), MAX_SESSIONS
    )
    fixed = F.lit(cfg.costs.buy_rate) * F.col("buys") + F.lit(cfg.costs.sell_rate) * F.col("sells")
    return filled.join(dated, "pos").withColumn("fixed_cost", fixed)


def at_notional(daily: DataFrame, notionals: Sequence[float]) -> DataFrame:
    """Net results for one or several book sizes (adds ``notional``, ``cost``, ``net_return``)."""
    sized = daily.withColumn("notional", F.explode(F.array(*[F.lit(float(n)) for n in notionals])))
    cost = F.when(
        F.col("notional") > 0, F.col("fixed_cost") + F.sqrt("notional") * F.col("impact_unit")
    ).otherwise(F.lit(0.0))
    return sized.withColumn("cost", cost).withColumn("net_return", F.col("gross_return") - F.col("cost"))


def summarize_backtest(daily: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sharpe, annualised return, turnover, cost, drawdown and diagnostics per key."""
    days = F.count(F.lit(1)).cast("double")
    years = days / F.lit(float(TRADING_DAYS))
    base = daily.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_days"),
        *[
            x
            for side in ("gross", "net")
            for x in (
                F.avg(f"{side}_return").alias(f"_m_{side}"),
                F.stddev_samp(f"{side}_return").alias(f"_s_{side}"),
                F.max(F.abs(f"{side}_return")).alias(f"_t_{side}"),
            )
        ],
        (F.sum("turnover") / years).alias("annual_turnover"),
        (F.lit(1e4) * F.sum("cost") / years).alias("total_cost_bps"),
        (F.sum("fixed_cost") * F.first("notional")).alias("total_fixed_cost"),
        (F.sum(F.col("cost") - F.col("fixed_cost")) * F.first("notional")).alias("total_impact_cost"),
        (F.sum("turnover") * F.first("notional")).alias("total_traded_value"),
        F.sum("missing_adv").alias("trades_without_adv"),
        F.sum("unpriced_days").alias("unpriced_position_days"),
        F.sum("unpriced_gross").alias("unpriced_gross_exposure"),
    )
    drawn = W.drawdown_summary(daily, keys, "net_return")
    annual = F.lit(float(TRADING_DAYS))
    out = base.join(drawn, list(keys)).withColumns(
        {
            **{
                f"{side}_sharpe": sharpe_from(
                    F.col(f"_m_{side}"), F.col(f"_s_{side}"), F.col(f"_t_{side}"), F.col("n_days")
                )
                * F.lit(math.sqrt(TRADING_DAYS))
                for side in ("gross", "net")
            },
            "gross_annual_return": F.col("_m_gross") * annual,
            "net_annual_return": F.col("_m_net") * annual,
        }
    )
    depth = F.abs("max_drawdown")
    calmar = ratio(F.col("net_annual_return"), F.when(depth > FLAT, depth))
    return out.withColumn("calmar", calmar).drop(*[f"_{m}_{s}" for m in "mst" for s in ("gross", "net")])
