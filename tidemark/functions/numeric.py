"""Small Column helpers shared by every operator.

The engine keeps a single notion of "missing": NULL. NaN and infinities are turned into
NULL at the edges because Spark orders NaN above every number and lets it through
``IS NOT NULL`` filters.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a side that may be broadcast; a larger proven bound means a shuffle join.
BROADCAST_ROW_LIMIT = 2_000_000

#: A session dimension holds distinct calendar dates: under 40 000 rows per century.
MAX_SESSIONS = 40_000

_NORMAL = NormalDist()


def broadcast_if_bounded(df: DataFrame, max_rows: int | None) -> DataFrame:
    """Broadcast hint only when the caller can prove a row bound below the limit.

    Without a proven bound no hint is given, so Spark picks the join from measured sizes.
    """
    if max_rows is not None and max_rows <= BROADCAST_ROW_LIMIT:
        return F.broadcast(df)
    return df


def finite(c: Column | str) -> Column:
    """The value when it is a finite number, else NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in every floating-point column."""
    floating = [n for n, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in floating}) if floating else df


def ratio(num: Column, den: Column) -> Column:
    """Division that is NULL on a zero or NULL denominator."""
    return F.try_divide(num, den)


def nondegenerate(stddev: Column, scale: Column) -> Column:
    """Standard deviation when it is distinguishable from zero relative to ``scale``."""
    return F.when(stddev > F.lit(1e-12) * F.greatest(scale, F.lit(1e-300)), stddev)


def normal_quantile(p: float) -> float:
    """Inverse standard normal for a single, plan-time probability."""
    return _NORMAL.inv_cdf(p)


@F.pandas_udf(T.DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    """Standard normal distribution function, Arrow batches (Spark has no ``erf``)."""
    return z.map(lambda v: 0.5 * math.erfc(-v / math.sqrt(2.0)), na_action="ignore").astype(float)


@F.pandas_udf(T.DoubleType())
def expected_max_normal(n: pd.Series) -> pd.Series:
    """Expected maximum of ``n`` standard normals (extreme-value form with Euler's gamma)."""
    gamma = 0.5772156649015329

    def one(k: int) -> float:
        if k <= 1:
            return 0.0
        high = _NORMAL.inv_cdf(1.0 - 1.0 / k)
        higher = _NORMAL.inv_cdf(1.0 - 1.0 / (k * math.e))
        return (1.0 - gamma) * high + gamma * higher

    return n.map(one, na_action="ignore").astype(float)
