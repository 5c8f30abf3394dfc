"""Whole studies: factor evaluation, conditional study, overlays and daily signals."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import BookConfig, CompositeConfig, DrawdownControl, FactorConfig, VolTarget
from ..functions.numeric import MAX_SESSIONS, broadcast_if_bounded
from ..operators import backtest as B
from ..operators import risk as R
from ..operators.columnar import rank_ic_columns, tail_columns, treat_columns, treated_long
from ..operators.factors import GRID_INPUTS, Factor, build_panels, factor_wide
from ..operators.inference import summarize_ic
from ..operators.labels import forward_returns, horizon_long, rank_ic
from ..operators.sharpe import deflated_sharpe
from ..session import stage


@dataclass
class Study:
    """Shared inputs of a study; panel and ICs are staged once and read by every branch."""

    prices: DataFrame
    sessions: DataFrame
    panel: DataFrame
    labels: DataFrame
    names: tuple[str, ...]
    horizons: tuple[int, ...] = ()
    wide: DataFrame | None = None  # date, symbol, a treated column per factor (``treated``), fwd_h
    treated: dict[str, str] | None = None


def prepare(
    prices: DataFrame,
    sessions: DataFrame,
    factors: Sequence[Factor],
    cfg: FactorConfig,
    horizons: Sequence[int],
    *,
    shares: DataFrame | None = None,
    mapping: DataFrame | None = None,
) -> Study:
    """Panel and labels share one window stage and one staged wide table, of which both are views.

    Sector-neutral panels are built in long form.
    """
    prices = stage(prices.select("date", "symbol", *GRID_INPUTS), "prices")  # what factors and backtests read
    names = tuple(f.name for f in factors)
    if not cfg.sector_neutralize:
        raw = stage(factor_wide(prices, sessions, factors, horizons, shares=shares), "wide")
        wide, treated = treat_columns(raw, names, winsor=cfg.winsor)
        panel = treated_long(wide, {n: (n, treated[n]) for n in names}, "factor", ["date", "symbol", "pos"])
        return Study(prices, sessions, panel, horizon_long(raw, horizons), names, tuple(horizons), wide, treated)
    panel = stage(build_panels(prices, sessions, factors, cfg, shares=shares, mapping=mapping), "panel")
    labels = horizon_long(forward_returns(prices, sessions, horizons), horizons)
    return Study(prices, sessions, panel, labels, names, tuple(horizons))


def ic_series(study: Study, min_names: int, horizons: Sequence[int] | None = None) -> DataFrame:
    """Rank ICs of every factor at ``horizons`` (default: all of the study's)."""
    asked = study.horizons if horizons is None else horizons
    if study.wide is not None:
        return rank_ic_columns(study.wide, study.treated, {h: f"fwd_{h}" for h in asked}, min_names=min_names)
    labels = study.labels.filter(F.col("horizon").isin(*asked))
    return rank_ic(study.panel, labels, series=("factor", "horizon"), min_names=min_names)


def ic_table(study: Study, min_names: int) -> DataFrame:
    """IC summary of every factor and horizon."""
    series = stage(ic_series(study, min_names), "ic")
    return summarize_ic(series, ["factor", "horizon"], F.col("horizon")).withColumn("deflated", F.lit(False))


def strategy_panel(study: Study) -> DataFrame:
    return study.panel.withColumnRenamed("factor", "strategy")


def _column_targets(wide: DataFrame, columns: dict[str, str], cfg: BookConfig, tie_code: Column | None) -> DataFrame:
    return tail_columns(
        wide, columns, n_quantiles=cfg.n_quantiles, leverage=cfg.leverage, long_only=cfg.long_only, tie_code=tie_code
    )


def factor_targets(study: Study, cfg: BookConfig, tie_code: Column | None = None) -> DataFrame:
    if study.wide is not None:
        return _column_targets(study.wide, study.treated, cfg, tie_code)
    return B.target_weights(
        strategy_panel(study),
        study.sessions,
        cfg,
        n_series=len(study.names),
        tie_code=tie_code,
    )


def evaluate_factors(
    study: Study, cfg: BookConfig, notionals: Sequence[float], tie_code: Column | None = None
) -> DataFrame:
    """Daily results of every factor at several book sizes from a single pass."""
    daily = B.run_backtest(factor_targets(study, cfg, tie_code), study.prices, study.sessions, cfg)
    return B.at_notional(daily, notionals)


def factor_cards(
    ic: DataFrame, summary: DataFrame, daily: DataFrame, horizon: int, n_trials: Column | int
) -> DataFrame:
    """IC at one horizon next to Sharpe, costs, trial count and deflated probability."""
    entry = ic.filter(F.col("horizon") == horizon)
    deflated = deflated_sharpe(daily, ["strategy"], "net_return", n_trials)
    return (
        entry.withColumnRenamed("factor", "strategy")
        .join(summary, "strategy")
        .join(deflated.select("strategy", "n_trials", "dsr"), "strategy")
        .select(
            F.col("strategy").alias("factor"),
            "horizon",
            "mean_ic",
            "ic_ir",
            "t_stat",
            "hit_rate",
            "n_dates",
            "gross_sharpe",
            "net_sharpe",
            "annual_turnover",
            "total_cost_bps",
            "n_trials",
            "dsr",
        )
    )


def conditional_study(
    study: Study,
    labels: DataFrame,
    experiments: DataFrame,
    verdicts: DataFrame,
    cfg: BookConfig,
    *,
    fixed_scale: float = 1.0,
    tie_code: Column | None = None,
) -> DataFrame:
    """One row per declared experiment: its verdict and power, and what trading on it would have earned.

    The conditional strategy holds the factor's signal in the favourable regime and is flat elsewhere; it is
    set against the unconditional factor at the book's size and at ``fixed_scale``, where impact vanishes.
    All strategies share one backtest. ``experiments`` are declared, so a handful; ``verdicts`` hold
    ``factor, regime_column, verdict, power_at_reference``.
    """
    named = stage(experiments.select("factor", "regime_column", "favourable", F.concat_ws("|", "factor", "regime_column").alias("strategy")), "experiments")
    days = labels.join(F.broadcast(named), "regime_column")
    inside = days.filter(F.col("regime") == F.col("favourable")).select("strategy", "date", F.lit(True).alias("_on"))
    targets = _conditional_targets(study, named, inside, cfg, tie_code)
    daily = stage(B.at_notional(B.run_backtest(targets, study.prices, study.sessions, cfg), [cfg.notional, fixed_scale]), "daily")
    sharpe = stage(B.summarize_backtest(daily, ["strategy", "notional"]).select("strategy", "notional", "net_sharpe"), "sharpe")
    out = named.join(verdicts.select("factor", "regime_column", "verdict", "power_at_reference"), ["factor", "regime_column"])
    exposure = days.groupBy("strategy").agg(F.avg((F.col("regime") == F.col("favourable")).cast("double")).alias("exposure"))
    out = out.join(exposure, "strategy", "left")
    for scale, kind in ((cfg.notional, "net"), (fixed_scale, "fixed")):
        at = sharpe.filter(F.col("notional") == scale)
        out = out.join(at.select("strategy", F.col("net_sharpe").alias(f"{kind}_conditional")), "strategy", "left")
        out = out.join(at.select(F.col("strategy").alias("factor"), F.col("net_sharpe").alias(f"{kind}_unconditional")), "factor", "left")
        beats = F.coalesce(F.col(f"{kind}_conditional") > F.col(f"{kind}_unconditional"), F.lit(False))
        out = out.withColumn(f"beats_{kind}", beats)
    return out.drop("strategy", "favourable")


def _conditional_targets(
    study: Study, named: DataFrame, inside: DataFrame, cfg: BookConfig, tie_code: Column | None
) -> DataFrame:
    """Targets of the declared strategies, flat but on the dates of ``inside``, and of their factors as they are.

    Of a wide study each is one more column, so only the tails become a row per strategy.
    """
    declared = named.select("factor", "strategy").collect() if study.wide is not None else []
    if declared:
        on = [F.max(F.when(F.col("strategy") == d.strategy, True)).alias(f"_on_{i}") for i, d in enumerate(declared)]
        met = study.wide.join(broadcast_if_bounded(inside.groupBy("date").agg(*on), MAX_SESSIONS), "date", "left")
        columns = {d.factor: study.treated[d.factor] for d in declared}
        for i, d in enumerate(declared):
            flat = F.when(F.col(d.factor).isNotNull(), F.lit(0.0))
            met = met.withColumn(f"_held_{i}", F.when(F.col(f"_on_{i}"), F.col(study.treated[d.factor])).otherwise(flat))
            columns[d.strategy] = f"_held_{i}"
        return _column_targets(met, columns, cfg, tie_code)
    own = study.panel.join(F.broadcast(named.select("factor", "strategy")), "factor")
    value = F.when(F.col("_on"), F.col("value")).otherwise(F.lit(0.0))
    conditional = own.join(inside, ["strategy", "date"], "left").select("strategy", "date", "symbol", value.alias("value"))
    plain = study.panel.join(F.broadcast(named.select("factor").distinct()), "factor", "left_semi")
    both = stage(conditional.unionByName(plain.select(F.col("factor").alias("strategy"), "date", "symbol", "value")), "both")
    return B.target_weights(both, study.sessions, cfg, n_series=None, tie_code=tie_code)


def overlay_run(
    targets: DataFrame,
    prices: DataFrame,
    sessions: DataFrame,
    cfg: BookConfig,
    vol: VolTarget,
    drawdown: DrawdownControl,
    n_strategies: int,
) -> DataFrame:
    """Backtest under both overlays combined; adds their per-session diagnostics.

    Volatility scales need only the unlevered returns; the drawdown control is then folded
    over per-session aggregates; the final pass books the trades both cause.
    """
    bound = MAX_SESSIONS * n_strategies
    weights, names = _weights(targets, prices, sessions, cfg)
    plain = B.daily_results(B.unscaled(weights, cfg.holding), sessions, cfg, names)
    scales = stage(R.volatility_scale(_placed(plain), vol), "vol")
    if drawdown.enabled:
        voled = B.scaled_weights(weights, scales.select("strategy", "pos", "scale"), cfg.holding, max_rows=bound)
        inputs = R.feedback_inputs(voled, sessions, cfg, drawdown, names=names)
        states = R.drawdown_scale(inputs, cfg.holding, drawdown)
    else:
        states = scales.select(
            "strategy", "pos", F.lit(1.0).alias("dd_scale"), F.lit(None).cast("double").alias("drawdown"),
            F.lit(False).alias("derisked"),
        )
    both = stage(
        scales.join(states, ["strategy", "pos"]).withColumn("scale", F.col("scale") * F.col("dd_scale")), "scales"
    )
    sized = B.scaled_weights(weights, both.select("strategy", "pos", "scale"), cfg.holding, max_rows=bound)
    daily = B.daily_results(sized, sessions, cfg, names)
    return daily.join(broadcast_if_bounded(both.drop("dd_scale"), bound), ["strategy", "pos"])


def _weights(
    targets: DataFrame, prices: DataFrame, sessions: DataFrame, cfg: BookConfig
) -> tuple[DataFrame, DataFrame]:
    """Staged priced weights, from which every pass over the names starts, and the strategies."""
    targets = stage(targets, "targets")
    market = B.market_steps(prices, sessions, cfg.costs.adv_window)
    weights = stage(B.priced_weights(targets, sessions, market, cfg.holding), "weights")
    return weights, stage(targets.select("strategy").distinct(), "names")


def _placed(daily: DataFrame) -> DataFrame:
    return daily.select("strategy", "pos", "unit_return")


def overlay_variants(vol_window: int, long_window: int, target: float) -> dict[str, tuple[VolTarget, DrawdownControl]]:
    """The declared overlay variants a study compares with its own unscaled baseline."""
    relative = VolTarget(True, "relative", target, vol_window, long_window, vol_window)
    off = DrawdownControl()
    on = DrawdownControl(enabled=True)
    return {
        "none": (VolTarget(), off),
        "vol_absolute": (VolTarget(True, "absolute", target, vol_window, long_window, vol_window), off),
        "vol_relative": (relative, off),
        "vol_delever": (
            VolTarget(True, "relative", target, vol_window, long_window, vol_window, de_lever_only=True),
            off,
        ),
        "drawdown": (VolTarget(), on),
        "relative+dd": (relative, on),
    }


def overlay_grid(
    targets: DataFrame,
    prices: DataFrame,
    sessions: DataFrame,
    cfg: BookConfig,
    variants: dict[str, tuple[VolTarget, DrawdownControl]],
    n_strategies: int,
) -> DataFrame:
    """Summary per (variant, strategy).

    All variants share the priced weights of the names and differ by multiples per session only; those without an
    overlay are the unlevered pass.
    """
    bound = MAX_SESSIONS * n_strategies
    weights, names = _weights(targets, prices, sessions, cfg)
    plain = stage(B.daily_results(B.unscaled(weights, cfg.holding), sessions, cfg, names), "plain")
    results, parts = [], []
    for name, (vol, drawdown) in variants.items():
        if not (vol.enabled or drawdown.enabled):
            results.append(plain.withColumn("variant", F.lit(name)))
            continue
        scales = R.volatility_scale(_placed(plain), vol).select("strategy", "pos", "scale")
        if drawdown.enabled:
            scales = stage(scales, "vol")
            voled = B.scaled_weights(weights, scales, cfg.holding, max_rows=bound)
            states = R.drawdown_scale(R.feedback_inputs(voled, sessions, cfg, drawdown, names=names), cfg.holding, drawdown)
            scales = scales.join(states.select("strategy", "pos", "dd_scale"), ["strategy", "pos"]).select(
                "strategy", "pos", (F.col("scale") * F.col("dd_scale")).alias("scale")
            )
        parts.append(scales.withColumn("variant", F.lit(name)))
    keys = ["variant", "strategy"]
    if parts:
        every = stage(reduce(DataFrame.unionByName, parts), "scales")
        sized = B.scaled_weights(weights, every, cfg.holding, max_rows=bound)
        scaled = names.crossJoin(F.broadcast(every.select("variant").distinct()))
        results.append(B.daily_results(sized, sessions, cfg, scaled, keys=keys))
    daily = B.at_notional(reduce(DataFrame.unionByName, results), [cfg.notional])
    return B.summarize_backtest(stage(daily, "daily"), keys)


def composite_ic(study: Study, cfg: CompositeConfig, min_names: int) -> DataFrame:
    """IC series of every factor at the composite's horizon."""
    return ic_series(study, min_names, [cfg.horizon] if cfg.horizon in study.horizons else [])
