"""Cross-sections of wide panels: a row per name and session, a column per series.

A long panel repeats its keys for every series and label, and moves and sorts each of those rows. Here the rows of a
date meet in one task after one shuffle, whatever the number of series, as Arrow columns of doubles. Dates of more
than ``limit`` rows go in long form by value buckets, with the same results. Non-finite values count as missing.

Frames carry ``date``; they are read several times, so pass staged ones.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import MAX_SESSIONS, broadcast_if_bounded, nondegenerate, ratio
from ..functions.ranking import by_size, group_quantiles
from ..session import stage
from .crosssection import tail_weights
from .labels import joint_ic

#: Rows of a date that one task may hold as arrays: 96 MB at a dozen columns.
DATE_LIMIT = 1_000_000


def long_view(df: DataFrame, columns: Mapping[object, str], name: str, keep: Sequence[str], value: str = "value") -> DataFrame:
    """``(name, keep, value)`` of every defined value; ``columns`` maps the name's values to columns."""
    pairs = F.array(*[F.struct(F.lit(k).alias(name), F.col(c).alias(value)) for k, c in columns.items()])
    return df.select(*keep, F.inline(pairs)).filter(F.col(value).isNotNull()).select(name, *keep, value)


def _numbers(table: pa.Table, column: str) -> np.ndarray:
    x = table.column(column).to_numpy()
    return np.where(np.isfinite(x), x, np.nan)


def _quantile(ordered: np.ndarray, p: float) -> float:
    at = p * (len(ordered) - 1)
    low, high = ordered[int(np.floor(at))], ordered[int(np.ceil(at))]
    return low + (high - low) * (at - np.floor(at))


_STATS = ("lo", "hi", "mean", "sd", "cnt", "top")


def _date_stats(columns: Sequence[str], lower: float, upper: float):
    def run(table: pa.Table) -> pa.Table:
        found = []
        for c in columns:
            x = _numbers(table, c)
            x = x[~np.isnan(x)]
            if not len(x):
                found += [None, None, None, None, 0, None]
                continue
            ends = np.partition(x, sorted({int(f(p * (len(x) - 1))) for p in (lower, upper) for f in (np.floor, np.ceil)}))
            lo, hi = _quantile(ends, lower), _quantile(ends, upper)
            x = np.clip(x, lo, hi)
            found += [lo, hi, x.mean(), x.std(ddof=1) if len(x) > 1 else None, len(x), np.abs(x).max()]
        names = [f"_{s}_{i}" for i in range(len(columns)) for s in _STATS]
        kinds = [pa.int64() if s == "cnt" else pa.float64() for _ in columns for s in _STATS]
        arrays = [pa.array([v], k) for v, k in zip(found, kinds, strict=True)]
        return pa.Table.from_arrays([table.column("date").combine_chunks()[:1], *arrays], names=["date", *names])

    return run


def date_stats(df: DataFrame, columns: Sequence[str], winsor: tuple[float, float], limit: int = DATE_LIMIT) -> DataFrame:
    """Per date and column ``i``: ``_lo_i``, ``_hi_i``, and moments of what is clipped to them; a row per date."""
    light, heavy = by_size(df.select("date", *columns), ["date"], limit)
    kinds = ", ".join(f"_{s}_{i} {'long' if s == 'cnt' else 'double'}" for i in range(len(columns)) for s in _STATS)
    stats = light.groupBy("date").applyInArrow(_date_stats(columns, *winsor), f"date date, {kinds}")
    if heavy is None:
        return stats
    long = stage(long_view(heavy, dict(enumerate(columns)), "_i", ["date"]), "heavy-dates")
    by, bound = ["_i", "date"], MAX_SESSIONS * len(columns)
    ends = stage(group_quantiles(long, by, "value", {"_lo": winsor[0], "_hi": winsor[1]}, max_groups=bound), "ends")
    clipped = F.least(F.greatest("value", "_lo"), "_hi")
    moments = long.join(broadcast_if_bounded(ends, bound), by).withColumn("value", clipped).groupBy(*by).agg(
        F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"), F.avg("value").alias("_mean"),
        F.stddev_samp("value").alias("_sd"), F.count("value").alias("_cnt"), F.max(F.abs("value")).alias("_top"),
    )
    spread = [
        F.max(F.when(F.col("_i") == i, F.col(f"_{s}"))).alias(f"_{s}_{i}") for i in range(len(columns)) for s in _STATS
    ]
    return stats.unionByName(moments.groupBy("date").agg(*spread))


def treat_columns(
    df: DataFrame, columns: Sequence[str], *, winsor: tuple[float, float] = (0.01, 0.99), min_count: int = 2,
    limit: int = DATE_LIMIT,
) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with a clipped and standardised column next to each of ``columns``, and their names.

    The rows stay where they are: the statistics, a row per date, are broadcast.
    """
    stats = stage(date_stats(df, columns, winsor, limit), "date-stats")
    names = {c: f"_treated_{i}" for i, c in enumerate(columns)}

    def one(i: int, c: str) -> Column:
        sd = F.when(F.col(f"_cnt_{i}") >= min_count, nondegenerate(F.col(f"_sd_{i}"), F.col(f"_top_{i}")))
        clipped = F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), f"_lo_{i}"), f"_hi_{i}"))
        return ratio(clipped - F.col(f"_mean_{i}"), sd).alias(names[c])

    joined = df.join(broadcast_if_bounded(stats, MAX_SESSIONS), "date", "left")
    return joined.select(*df.columns, *[one(i, c) for i, c in enumerate(columns)]), names


def treated_long(treated: DataFrame, names: Mapping[object, tuple[str, str]], name: str, keep: Sequence[str]) -> DataFrame:
    """``(name, keep, value)``: a row per defined raw value, as :func:`crosssection.treat` gives it.

    ``names`` maps the name's values to a raw and a treated column; without dispersion the value is NULL.
    """
    pairs = F.array(
        *[F.struct(F.lit(k).alias(name), F.col(raw).isNotNull().alias("_has"), F.col(c).alias("value")) for k, (raw, c) in names.items()]
    )
    return treated.select(*keep, F.inline(pairs)).filter("_has").select(name, *keep, "value")


def _mean_ranks(ordered: np.ndarray) -> np.ndarray:
    """Average ranks of ascending values."""
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    ties = np.diff(np.r_[first, len(ordered)])
    return np.repeat(first + (ties + 1) / 2.0, ties)


def _correlation(rx: np.ndarray, ry: np.ndarray) -> float | None:
    dx, dy = rx - rx.mean(), ry - ry.mean()
    spread = float(np.sqrt(dx @ dx / len(dx)) * np.sqrt(dy @ dy / len(dy)))
    return float(dx @ dy / len(dx)) / spread if spread else None


def _date_ic(values: Sequence[str], rets: Sequence[str], min_names: int):
    def run(table: pa.Table) -> pa.Table:
        ys = [_numbers(table, c) for c in rets]
        orders = [np.argsort(y, kind="stable") for y in ys]
        out: list[tuple] = []
        for i, c in enumerate(values):
            x = _numbers(table, c)
            by_x, has = np.argsort(x, kind="stable"), ~np.isnan(x)
            for j, (y, by_y) in enumerate(zip(ys, orders, strict=True)):
                both = has & ~np.isnan(y)
                n = int(both.sum())
                if n < max(min_names, 1):
                    continue
                ranks = np.empty((2, len(x)))
                for k, (v, order) in enumerate(((x, by_x), (y, by_y))):
                    order = order[both[order]]
                    ranks[k][order] = _mean_ranks(v[order])
                out.append((i, j, _correlation(ranks[0][both], ranks[1][both]), n))
        day = table.column("date").combine_chunks()[:1].take(pa.array([0] * len(out), pa.int32()))
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        kinds = (pa.int32(), pa.int32(), pa.float64(), pa.int64())
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        return pa.Table.from_arrays([day, *arrays], names=["date", "_x", "_y", "ic", "n"])

    return run


def rank_ic_columns(
    df: DataFrame,
    values: Mapping[object, str],
    rets: Mapping[object, str],
    *,
    series: tuple[str, str] = ("factor", "horizon"),
    min_names: int = 10,
    limit: int = DATE_LIMIT,
) -> DataFrame:
    """``(series, date, ic, n)`` of every value column with every label column, as :func:`labels.rank_ic` gives it.

    ``values`` and ``rets`` map the values of the two ``series`` columns to columns of ``df``. Each column is sorted
    once per date and every pair of columns is ranked over its joint names from those orders.
    """
    picked = df.select("date", *[F.col(c).alias(f"_x{i}") for i, c in enumerate(values.values())],
                       *[F.col(c).alias(f"_y{j}") for j, c in enumerate(rets.values())])
    xs, ys = [f"_x{i}" for i in range(len(values))], [f"_y{j}" for j in range(len(rets))]
    light, heavy = by_size(picked, ["date"], limit)
    ic = light.groupBy("date").applyInArrow(_date_ic(xs, ys, min_names), "date date, _x int, _y int, ic double, n long")
    if heavy is not None:
        long = long_view(long_view(heavy, dict(enumerate(xs)), "_i", ["date", *ys], "_vx"), dict(enumerate(ys)), "_j", ["_i", "date", "_vx"], "_vy")
        joint = long.select("_i", "_j", "date", F.col("_vx").alias("_x"), F.col("_vy").alias("_y"))
        found = joint_ic(joint, ["_i", "_j", "date"], min_names)
        ic = ic.unionByName(found.select("date", F.col("_i").alias("_x"), F.col("_j").alias("_y"), "ic", "n"))
    key = lambda given, at: F.element_at(F.array(*[F.lit(k) for k in given]), F.col(at) + 1)
    return ic.select(key(values, "_x").alias(series[0]), key(rets, "_y").alias(series[1]), "date", "ic", "n")


def _date_tails(columns: Sequence[str], n_quantiles: int, gross: float, long_only: bool):
    def run(table: pa.Table) -> pa.Table:
        symbols = table.column("symbol").combine_chunks()
        by_symbol = pc.sort_indices(symbols).to_numpy().astype(np.int64)
        rows, weights, which = [np.empty(0, np.int64)], [np.empty(0)], [np.empty(0, np.int32)]
        for i, c in enumerate(columns):
            x = _numbers(table, c)[by_symbol]
            known = np.flatnonzero(~np.isnan(x))
            n = len(known)
            if n < n_quantiles:
                continue
            size = max(1, n // n_quantiles)
            order = by_symbol[known[np.argsort(x[known], kind="stable")]]  # ties stay in symbol order
            sides = ((1, order[max(size, n - size):]),) if long_only else ((-1, order[:size]), (1, order[max(size, n - size):]))
            for side, picked in sides:
                rows.append(picked)
                weights.append(np.full(len(picked), side * gross / size))
                which.append(np.full(len(picked), i, np.int32))
        at = pa.array(np.concatenate(rows))
        arrays = [table.column("pos").combine_chunks().take(at), pa.array(np.concatenate(which)), symbols.take(at), pa.array(np.concatenate(weights))]
        return pa.Table.from_arrays(arrays, names=["pos", "_x", "symbol", "weight"])

    return run


def tail_columns(
    df: DataFrame,
    columns: Mapping[object, str],
    name: str = "strategy",
    *,
    n_quantiles: int = 5,
    leverage: float = 1.0,
    long_only: bool = False,
    tie_code: Column | None = None,
    limit: int = DATE_LIMIT,
) -> DataFrame:
    """``(name, symbol, pos, weight)`` of every column's long and short tails, as :func:`crosssection.tail_weights` gives them.

    ``df`` carries ``date``, ``pos`` and ``symbol``; ``columns`` maps the name's values to its columns. Names of a date
    are sorted once and every column from that order; only the tails become a row per column and name.
    """
    picked = df.select("date", "pos", "symbol", *[F.col(c).alias(f"_x{i}") for i, c in enumerate(columns.values())])
    xs = [f"_x{i}" for i in range(len(columns))]
    light, heavy = by_size(picked, ["date"], limit)
    gross = leverage if long_only else 0.5 * leverage
    run = _date_tails(xs, n_quantiles, gross, long_only)
    tails = light.groupBy("date").applyInArrow(run, "pos int, _x int, symbol string, weight double")
    if heavy is not None:
        long = stage(long_view(heavy, dict(enumerate(xs)), "_x", ["date", "pos", "symbol"]), "heavy-dates")
        found = tail_weights(long, by=["_x", "date", "pos"], n_quantiles=n_quantiles, leverage=leverage, long_only=long_only,
                             tie_code=tie_code, max_groups=MAX_SESSIONS * len(xs))
        tails = tails.unionByName(found.select("pos", "_x", "symbol", "weight"))
    key = F.element_at(F.array(*[F.lit(k) for k in columns]), F.col("_x") + 1)
    return tails.select(key.alias(name), "symbol", "pos", "weight")
