"""Market-wide flow features and regime labels per session.

Three series (institutional foreign and domestic, retail) are computed together, keyed by
``series``. Values are shifted by one session before anything is accumulated, so the row of
session ``d`` only knows flows up to ``d - 1``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RegimeConfig
from . import windows as W

#: series name -> participant it follows
SERIES = {"fii": "FII", "dii": "DII", "retail": "Client"}

REGIME_COLUMNS = ("fii_regime", "retail_regime", "retail_extreme", "flow_divergence", "flow_shock")


def aligned_series(flows: DataFrame, sessions: DataFrame) -> DataFrame:
    """``(series, pos, date, value)`` on every session, NULL where nothing was published."""
    names = F.array(
        *[F.struct(F.lit(s).alias("series"), F.lit(p).alias("participant")) for s, p in SERIES.items()]
    )
    spine = sessions.select("date", "pos", F.inline(names))
    observed = flows.select("date", "participant", F.col("net_futures").alias("value"))
    return spine.join(observed, ["date", "participant"], "left").drop("participant")


def flow_features(flows: DataFrame, sessions: DataFrame, cfg: RegimeConfig) -> DataFrame:
    """One row per session: trailing flows, their regime labels and the shock flag."""
    keys = ("series",)
    daily = aligned_series(flows, sessions).withColumn("daily", W.shifted("value", 1, keys))
    summed = daily.withColumn("flow", W.trailing_sum("daily", cfg.window, keys))
    labelled = W.expanding_counts(summed, keys, "flow").withColumn(
        "regime", W.expanding_bucket("flow", cfg.n_buckets, cfg.min_obs)
    )
    sized = labelled.drop("hist_n", "hist_lt", "hist_le").withColumn("size", F.abs("daily"))
    flagged = W.expanding_counts(sized, keys, "size").withColumn(
        "shock", W.expanding_flag("size", cfg.shock_percentile, cfg.min_obs)
    )

    def of(series: str, column: str) -> Column:
        return F.max(F.when(F.col("series") == series, F.col(column)))

    wide = flagged.groupBy("date", "pos").agg(
        *[of(s, "flow").alias(f"{s}_flow") for s in SERIES],
        of("fii", "daily").alias("fii_daily"),
        of("retail", "daily").alias("retail_daily"),
        of("fii", "regime").alias("fii_regime"),
        of("retail", "regime").alias("retail_regime"),
        of("fii", "shock").alias("flow_shock"),
    )
    return wide.withColumns(
        {
            "retail_extreme": W.collapse_extreme(F.col("retail_regime")),
            "flow_divergence": W.divergence(F.col("fii_flow"), F.col("dii_flow")),
        }
    )


def regime_labels(features: DataFrame, columns: tuple[str, ...] = REGIME_COLUMNS) -> DataFrame:
    """Defined labels as ``(date, regime_column, regime)`` text rows."""
    present = [c for c in columns if c in features.columns]
    missing = sorted(set(columns) - set(present))
    if missing and columns != REGIME_COLUMNS:
        raise ValueError(f"the features hold no regime named {missing}")
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("regime_column"), F.col(c).cast("string").alias("regime"))
            for c in present
        ]
    )
    return features.select("date", F.inline(pairs)).filter(F.col("regime").isNotNull())


def regime_coverage(features: DataFrame) -> DataFrame:
    """Defined sessions per regime column and bucket with the first and last date."""
    return regime_labels(features).groupBy("regime_column", "regime").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first_defined"), F.max("date").alias("last_defined")
    )
