"""Portfolio-level exposure overlays: volatility targeting and drawdown control."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import TRADING_DAYS, BookConfig, DrawdownControl, VolTarget
from ..functions.numeric import nondegenerate
from . import windows as W
from .backtest import session_spine
from .costs import priced


def _trailing_sd(window: int, keys: Sequence[str]) -> Column:
    frame = W.by_session(*keys).rowsBetween(-window, -1)
    return nondegenerate(F.stddev_samp("unit_return").over(frame), F.max(F.abs("unit_return")).over(frame))


def volatility_scale(daily: DataFrame, cfg: VolTarget, keys: Sequence[str] = ("strategy",)) -> DataFrame:
    """``(keys, pos, scale, realized_vol, target_vol)`` from unlevered returns before ``pos``.

    Scaling uses the unlevered book, so the estimate never chases its own leverage. Without
    enough history or dispersion the scale is 1.
    """
    before = F.count("unit_return").over(W.by_session(*keys).rowsBetween(Window.unboundedPreceding, -1))
    long_run = (
        _trailing_sd(cfg.long_window, keys)
        if cfg.mode == "relative"
        else F.lit(cfg.target_annual_vol / math.sqrt(TRADING_DAYS))
    )
    rows = daily.select(
        *keys, "pos", before.alias("_n"), _trailing_sd(cfg.window, keys).alias("_vol"), long_run.alias("_aim")
    )
    ready = F.lit(cfg.enabled) & (F.col("_n") >= cfg.needed)
    vol = F.when(ready, F.col("_vol"))
    aim = F.when(vol.isNotNull(), F.col("_aim"))
    upper = min(cfg.max_multiple, 1.0) if cfg.de_lever_only else cfg.max_multiple
    clipped = F.greatest(F.least(aim / vol, F.lit(upper)), F.lit(cfg.min_multiple))
    scaled = rows.select(
        *keys,
        "pos",
        F.when(aim.isNotNull(), clipped).otherwise(F.lit(1.0)).alias("scale"),
        vol.alias("realized_vol"),
        aim.alias("_target"),
    )
    last_seen = F.last("_target", ignorenulls=True).over(
        W.by_session(*keys).rowsBetween(Window.unboundedPreceding, 0)
    )
    return scaled.select(*keys, "pos", "scale", "realized_vol", last_seen.alias("target_vol"))


def feedback_inputs(
    weights: DataFrame,
    sessions: DataFrame,
    cfg: BookConfig,
    control: DrawdownControl,
    *,
    keys: Sequence[str] = ("strategy",),
    names: DataFrame,
) -> DataFrame:
    """Per session: return of each sleeve age and trading cost of each on/off combination.

    All per-name work happens here, distributed. What is left for the sequential fold is
    ``holding + 4`` numbers per session and strategy.
    """
    h = cfg.holding
    aged = weights.withColumns({f"w{k}": F.coalesce(F.col(f"w{k}") * F.col(f"s{k}"), F.lit(0.0)) for k in range(h + 1)})
    step = F.coalesce("step", F.lit(0.0))
    c = cfg.costs

    def cost(now: float, then: float) -> Column:
        delta = F.col("w0") * F.lit(now) - F.col(f"w{h}") * F.lit(then)
        size = F.abs(delta)
        impact = size * F.lit(c.impact_coef * math.sqrt(cfg.notional)) * F.sqrt(size / F.col("adv"))
        fixed = F.lit(c.buy_rate) * F.greatest(delta, F.lit(0.0)) + F.lit(c.sell_rate) * F.greatest(
            -delta, F.lit(0.0)
        )
        return F.sum(fixed + F.when(priced(F.col("adv")) & (size > 0), impact).otherwise(0.0))

    levels = (1.0, control.derisk_to)
    sums = aged.groupBy(*keys, "pos").agg(
        F.array(*[F.sum(F.col(f"w{k}") * step) for k in range(h)]).alias("parts"),
        F.array(*[cost(a, b) for a in levels for b in levels]).alias("costs"),
    )
    spine = session_spine(sessions, names).join(sums, [*keys, "pos"], "left")
    return spine.withColumns(
        {
            "parts": F.coalesce("parts", F.array_repeat(F.lit(0.0), h)),
            "costs": F.coalesce("costs", F.array_repeat(F.lit(0.0), 4)),
        }
    )


def drawdown_scale(
    inputs: DataFrame, holding: int, control: DrawdownControl, keys: Sequence[str] = ("strategy",)
) -> DataFrame:
    """``(keys, pos, dd_scale, drawdown, derisked)``: the sequential control per strategy.

    The state feeds back through realised net returns, so it must be folded in order. One
    group is one strategy's sessions: bounded by the calendar, independent of the names.
    """
    schema = T.StructType(
        [inputs.schema[k] for k in keys]
        + [
            T.StructField("pos", T.IntegerType()),
            T.StructField("dd_scale", T.DoubleType()),
            T.StructField("drawdown", T.DoubleType()),
            T.StructField("derisked", T.BooleanType()),
        ]
    )
    key_names = list(keys)

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values("pos")
        equity = peak = 1.0
        drawdown, low = 0.0, False
        used: list[float] = []
        rows = []
        for parts, costs in zip(ordered["parts"], ordered["costs"]):
            i = len(used)
            now = control.derisk_to if (control.enabled and low) else 1.0
            rows.append((now, drawdown, low))
            used.append(now)
            gross = sum(parts[k] * used[i - k] for k in range(min(holding, i + 1)))
            then = used[i - holding] if i >= holding else 1.0
            net = gross - costs[2 * (now != 1.0) + (then != 1.0)]
            equity *= 1.0 + net
            peak = max(peak, equity)
            drawdown = equity / peak - 1.0
            if low:
                low = drawdown < -control.restore_threshold
            else:
                low = drawdown <= -control.threshold
        state = pd.DataFrame(rows, columns=["dd_scale", "drawdown", "derisked"])
        head = ordered[[*key_names, "pos"]].reset_index(drop=True)
        return pd.concat([head, state], axis=1)

    return inputs.groupBy(*keys).applyInPandas(fold, schema)


def overlay_summary(daily: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How the overlay behaved: scale range, time above one, time de-risked."""
    scale = F.col("scale")
    return daily.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_sessions"),
        F.avg(scale).alias("mean_scale"),
        F.min(scale).alias("min_scale"),
        F.max(scale).alias("max_scale"),
        F.avg((scale > 1.0 + 1e-12).cast("double")).alias("fraction_levered"),
        F.sum(F.col("derisked").cast("int")).alias("sessions_derisked"),
    )


def compare_variants(summary: DataFrame, base: str = "none") -> DataFrame:
    """Per variant: strategies with a better net Sharpe or a shallower drawdown than ``base``.

    Differences below 1e-9 are summation noise between two passes, not an improvement.
    """
    plain = summary.filter(F.col("variant") == base).select(
        "strategy",
        F.col("net_sharpe").alias("_sharpe"),
        F.col("max_drawdown").alias("_drawdown"),
        F.col("annual_turnover").alias("_turnover"),
    )
    better = F.col("net_sharpe") > F.col("_sharpe") + 1e-9
    shallower = F.col("max_drawdown") > F.col("_drawdown") + 1e-9
    return (
        summary.filter(F.col("variant") != base)
        .join(plain, "strategy")
        .groupBy("variant")
        .agg(
            F.count(F.lit(1)).alias("n_strategies"),
            F.count(F.when(better, 1)).alias("improved_sharpe"),
            F.count(F.when(shallower, 1)).alias("reduced_drawdown"),
            F.min(F.col("annual_turnover") / F.col("_turnover")).alias("min_turnover_ratio"),
            F.max(F.col("annual_turnover") / F.col("_turnover")).alias("max_turnover_ratio"),
        )
    )
