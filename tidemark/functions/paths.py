"""Summaries of return paths that can be joined in time order.

A ``PathMetric`` says how one return is summed up, how the summary of a stretch is joined with that of the
stretch after it, and how the metric follows from a summary. So any union of time blocks can be scored
from one summary per block, however the metric depends on the order of returns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import ratio


@dataclass(frozen=True)
class PathMetric:
    start: Callable[[Column], Column]
    join: Callable[[Column, Column], Column]
    finish: Callable[[Column], Column]

    def of_returns(self, returns: Column) -> Column:
        """The summary of an array of returns in time order; NULL for an empty one."""
        rest = F.slice(returns, 2, F.greatest(F.size(returns) - 1, F.lit(0)))
        return F.when(F.size(returns) > 0, F.aggregate(rest, self.start(F.get(returns, F.lit(0))), lambda a, r: self.join(a, self.start(r))))

    def of_summaries(self, parts: Column) -> Column:
        """The summary of an array of summaries in time order."""
        rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
        return F.when(F.size(parts) > 0, F.aggregate(rest, F.get(parts, F.lit(0)), self.join))


def _growth(ret: Column) -> Column:
    x = F.lit(1.0) + ret
    return F.struct(x.alias("product"), x.alias("peak"), x.alias("trough"), F.lit(0.0).alias("worst"))


def _grown(a: Column, b: Column) -> Column:
    """Running products of the later stretch start from the earlier one's end."""
    across = ratio(a["product"] * b["trough"], a["peak"]) - 1
    return F.struct(
        (a["product"] * b["product"]).alias("product"),
        F.greatest(a["peak"], a["product"] * b["peak"]).alias("peak"),
        F.least(a["trough"], a["product"] * b["trough"]).alias("trough"),
        F.least(a["worst"], b["worst"], across).alias("worst"),
    )


#: The worst fall from a running peak (zero or below): higher is better.
MAX_DRAWDOWN = PathMetric(_growth, _grown, lambda s: s["worst"])


def _downside(ret: Column) -> Column:
    low = F.least(ret, F.lit(0.0))
    return F.struct(F.lit(1).cast("long").alias("n"), ret.alias("total"), (low * low).alias("squares"))


def _added(a: Column, b: Column) -> Column:
    return F.struct(*[(a[c] + b[c]).alias(c) for c in ("n", "total", "squares")])


#: Mean return over downside deviation; NULL without a loss.
SORTINO = PathMetric(
    _downside, _added, lambda s: ratio(s["total"] / s["n"], F.when(s["squares"] > 0, F.sqrt(s["squares"] / s["n"])))
)
