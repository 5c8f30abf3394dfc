"""Newey-West errors of a mean as Column expressions over an ordered array.

The array holds one value per session (or per session of one bucket), so its length is
bounded by the trading calendar, not by the data volume.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def automatic_lags(n: Column) -> Column:
    """floor(4 (n/100)^(2/9))."""
    return F.floor(F.lit(4.0) * F.pow(n / F.lit(100.0), F.lit(2.0 / 9.0))).cast("int")


def clamp_lags(lags: Column, n: Column) -> Column:
    return F.greatest(F.lit(0), F.least(lags.cast("int"), (n - 1).cast("int")))


def ordered_values(position: str, value: str) -> Column:
    """Aggregate expression: finite values of a group in position order."""
    kept = F.when(F.col(value).isNotNull(), F.struct(F.col(position).alias("p"), F.col(value).alias("v")))
    return F.transform(F.array_sort(F.collect_list(kept)), lambda s: s["v"])


def array_mean(xs: Column) -> Column:
    total = F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    return F.try_divide(total, F.size(xs).cast("double"))


def newey_west(xs: Column, mean: Column, lags: Column) -> Column:
    """Bartlett-kernel standard error of the mean; NULL below two observations.

    Falls back to the plain standard error when the variance estimate is not positive.
    """
    n = F.size(xs)
    z = F.transform(xs, lambda x: x - mean)
    square = F.aggregate(z, F.lit(0.0), lambda a, x: a + x * x)

    def gamma(k: Column) -> Column:
        pairs = F.zip_with(F.slice(z, 1, n - k), F.slice(z, k + 1, n - k), lambda a, b: a * b)
        return F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x) / n

    lagged = F.when(
        lags >= 1,
        F.aggregate(
            F.transform(
                F.sequence(F.lit(1), F.greatest(lags, F.lit(1))),
                lambda k: F.lit(2.0) * (F.lit(1.0) - k / (lags + F.lit(1.0))) * gamma(k),
            ),
            F.lit(0.0),
            lambda a, x: a + x,
        ),
    ).otherwise(F.lit(0.0))
    total = square / n + lagged
    plain = F.sqrt(square / (n - 1)) / F.sqrt(n.cast("double"))
    return F.when(n >= 2, F.when(total > 0, F.sqrt(total / n)).otherwise(plain))
