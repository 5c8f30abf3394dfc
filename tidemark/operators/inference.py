"""Summaries of IC series with autocorrelation-robust errors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import ratio
from ..functions.robust import automatic_lags, clamp_lags, newey_west, ordered_values


def mean_errors(
    df: DataFrame, keys: Sequence[str], value: str, order: str, lags: Column | None = None
) -> DataFrame:
    """Per key: ``n, mean, std, nw_lags, se`` of a series ordered by ``order``.

    ``lags`` is an expression over ``n`` and the keys; by default the automatic rule. A
    series holds one value per session, so collecting it is bounded by the calendar.
    """
    base = df.groupBy(*keys).agg(
        ordered_values(order, value).alias("_xs"),
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
    )
    asked = automatic_lags(F.col("n")) if lags is None else lags
    lagged = base.withColumn("nw_lags", F.when(F.col("n") >= 2, clamp_lags(asked, F.col("n"))).otherwise(0))
    return lagged.withColumn("se", newey_west(F.col("_xs"), F.col("mean"), F.col("nw_lags"))).drop("_xs")


def summarize_ic(ic: DataFrame, keys: Sequence[str], horizon: Column) -> DataFrame:
    """IC summary per key: mean, deviation, IR, robust t, hit rate, mean names."""
    lags = F.greatest(horizon - 1, automatic_lags(F.col("n")))
    errors = mean_errors(ic, keys, "ic", "date", lags)
    sides = ic.groupBy(*keys).agg(
        F.avg(F.when(F.col("ic").isNotNull(), (F.col("ic") > 0).cast("double"))).alias("hit_rate"),
        F.avg("n").alias("mean_names"),
    )
    joined = errors.join(sides, list(keys)) if keys else errors.join(sides)
    return joined.select(
        *keys,
        F.col("n").alias("n_dates"),
        F.col("mean").alias("mean_ic"),
        F.col("std").alias("std_ic"),
        F.when(F.col("std") > 0, ratio(F.col("mean"), F.col("std"))).alias("ic_ir"),
        F.when(F.col("se") > 0, ratio(F.col("mean"), F.col("se"))).alias("t_stat"),
        F.col("nw_lags").cast("long").alias("nw_lags"),
        "hit_rate",
        "mean_names",
    )
