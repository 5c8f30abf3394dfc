"""Trailing-IC factor weights, the composite signal and regime gates.

Weights of session ``t`` use only ICs whose label had been realised by ``t``. On the
session index that is a RANGE frame from ``window - 1`` back to ``horizon`` back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CompositeConfig, RegimeConfig
from ..functions.numeric import MAX_SESSIONS, broadcast_if_bounded, finite, ratio
from ..functions.robust import clamp_lags, newey_west
from .calendar import with_position
from .crosssection import zscore
from .panel import last_position, with_dates
from .regimes import expand_map


def series_spine(names: DataFrame, sessions: DataFrame) -> DataFrame:
    """Every session for every series (one row per series in ``names``)."""
    return names.withColumn("pos", F.explode(F.sequence(F.lit(0), last_position(sessions))))


def _realised(keys: Sequence[str], cfg: CompositeConfig) -> Window:
    return Window.partitionBy(*keys).orderBy("pos").rangeBetween(-(cfg.window - 1), -cfg.horizon)


def trailing_weights(ic: DataFrame, sessions: DataFrame, cfg: CompositeConfig) -> DataFrame:
    """``(date, factor, weight)``; weights of a session sum to one in absolute value."""
    placed = with_position(ic.select("factor", "date", "ic"), sessions).drop("date")
    spine = series_spine(ic.select("factor").distinct(), sessions).join(placed, ["factor", "pos"], "left")
    if cfg.horizon > cfg.window - 1:
        spine = spine.filter(F.lit(False))
    frame = _realised(["factor"], cfg)
    stats = spine.select(
        "factor",
        "pos",
        F.count("ic").over(frame).alias("_n"),
        F.avg("ic").over(frame).alias("_mean"),
        F.stddev_samp("ic").over(frame).alias("_sd"),
    ).filter(F.col("_n") >= 2)
    score: Column = {
        "equal": F.lit(1.0),
        "ic_mean": F.col("_mean"),
        "ic_ir": F.coalesce(ratio(F.col("_mean"), F.when(F.col("_sd") > 0, F.col("_sd"))), F.lit(0.0)),
    }[cfg.scheme]
    scored = stats.withColumn("_score", score)
    if cfg.drop_negative and cfg.scheme != "equal":
        scored = scored.filter(F.col("_score") > 0)
    total = F.sum(F.abs("_score")).over(Window.partitionBy("pos"))
    weighted = scored.withColumn("_total", total).filter(F.col("_total") > 0)
    return with_dates(weighted.select("factor", "pos", (F.col("_score") / F.col("_total")).alias("weight")), sessions).select(
        "date", "factor", "weight"
    )


def composite(panel: DataFrame, weights: DataFrame, cfg: CompositeConfig, n_factors: int | None = None) -> DataFrame:
    """Weighted mean of the factors available for a name, standardised per date."""
    bound = None if n_factors is None else MAX_SESSIONS * n_factors
    joined = panel.select("date", "symbol", "factor", finite("value").alias("value")).join(
        broadcast_if_bounded(weights, bound), ["date", "factor"]
    ).filter(F.col("value").isNotNull() & F.col("weight").isNotNull())
    mixed = joined.groupBy("date", "symbol").agg(
        F.sum(F.col("value") * F.col("weight")).alias("_num"),
        F.sum(F.abs("weight")).alias("_den"),
        F.count(F.lit(1)).alias("_coverage"),
    ).filter((F.col("_coverage") >= cfg.min_coverage) & (F.col("_den") > 0))
    return zscore(mixed.select("date", "symbol", (F.col("_num") / F.col("_den")).alias("value")))


def regime_gates(
    ic: DataFrame,
    labels: DataFrame,
    sessions: DataFrame,
    cfg: CompositeConfig,
    regime: RegimeConfig,
    min_obs: int = 20,
    tested_only: bool = True,
) -> DataFrame:
    """``(date, factor, regime_column, bucket, t_stat, n_obs, on)`` for every mapped factor.

    With ``tested_only`` factors without any IC in a defined bucket pass ungated. A factor is ON when its realised ICs on sessions sharing today's bucket have a robust t
    above the gate. Undefined buckets and thin samples are OFF.
    """
    mapped = expand_map(ic.select("factor").distinct(), regime.factor_map).select("factor", "regime_column")
    bucket = broadcast_if_bounded(
        with_position(labels, sessions).select("regime_column", "pos", F.col("regime").alias("bucket")),
        MAX_SESSIONS * 8,
    )
    placed = with_position(ic.select("factor", "date", "ic"), sessions).drop("date")
    rows = (
        series_spine(mapped, sessions)
        .join(bucket, ["regime_column", "pos"], "left")
        .join(placed, ["factor", "pos"], "left")
    )
    if tested_only:
        testable = rows.filter(F.col("bucket").isNotNull() & F.col("ic").isNotNull()).select("factor").distinct()
        rows = rows.join(testable, "factor", "left_semi")
    frame = _realised(["factor", "regime_column", "bucket"], cfg)
    sampled = rows.select(
        "factor",
        "regime_column",
        "pos",
        "bucket",
        F.collect_list("ic").over(frame).alias("_xs"),
        F.avg("ic").over(frame).alias("_mean"),
    )
    known = F.col("bucket").isNotNull()
    sized = sampled.withColumn("n_obs", F.when(known, F.size("_xs")).otherwise(0).cast("long"))
    lags = clamp_lags(F.lit(max(cfg.horizon - 1, 1)), F.col("n_obs"))
    enough = F.col("n_obs") >= min_obs
    tested = sized.withColumn("_se", F.when(enough, newey_west(F.col("_xs"), F.col("_mean"), lags)))
    t = ratio(F.col("_mean"), F.when(F.col("_se") > 0, F.col("_se")))
    decided = tested.withColumn("t_stat", t).withColumn(
        "on", F.coalesce(F.col("t_stat") >= regime.gate_t, F.lit(False))
    )
    return with_dates(decided, sessions).select(
        "date", "factor", "regime_column", "bucket", "t_stat", "n_obs", "on"
    )


def gated_panel(panel: DataFrame, gates: DataFrame, n_factors: int | None = None) -> DataFrame:
    """Zero the signal of gated factors on OFF sessions; unmapped factors pass through."""
    bound = None if n_factors is None else MAX_SESSIONS * n_factors
    decisions = broadcast_if_bounded(gates.select("date", "factor", "on"), bound)
    off = F.coalesce(~F.col("on"), F.lit(False))
    return (
        panel.join(decisions, ["date", "factor"], "left")
        .withColumn("value", F.when(off, F.lit(0.0)).otherwise(F.col("value")))
        .drop("on")
    )


def gated_ic(ic: DataFrame, gates: DataFrame) -> DataFrame:
    """``ic`` without the sessions on which a factor was OFF: a flat cross-section has no IC."""
    off = gates.filter(~F.col("on")).select("factor", "date")
    return ic.join(off, ["factor", "date"], "left_anti")


def on_fraction(gates: DataFrame) -> DataFrame:
    return gates.groupBy("factor").agg(F.avg(F.col("on").cast("double")).alias("on_fraction"))
