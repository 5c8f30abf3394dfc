"""Constrained portfolio construction and trade lists, for every decision date at once.

A decision date selects at most ``2 x top_n`` names, so everything after the selection works
on groups bounded by the parameter. The selection itself uses bucketed tails and accepts any
number of candidates.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ConstructionConfig, CostConfig
from ..functions.numeric import MAX_SESSIONS, broadcast_if_bounded, ratio
from ..functions.ranking import select_tails
from ..session import stage
from .costs import fixed_cost, impact_bps, priced

HELD = 1e-12


def water_fill(df: DataFrame, group: Sequence[str], mag: str, cap: str, target: str, out: str) -> DataFrame:
    """Spread ``target`` over a group in proportion to ``mag``, nobody above ``cap``.

    Sorted by ``cap / mag``, the common level is the first one that saturates nobody further
    down the order. When the caps cannot hold the target every item sits at its cap.
    """
    share = F.try_divide(F.col(cap), F.col(mag))
    order = Window.partitionBy(*group).orderBy(share, mag)
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    # Summed from the row on: a total less a prefix would lose small magnitudes next to large ones.
    left_mag = F.sum(mag).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = F.try_divide(F.col(target) - F.coalesce(F.sum(cap).over(ahead), F.lit(0.0)), left_mag)
    levels = df.withColumns({"_level": level, "_i": F.row_number().over(order)})
    first = F.min_by(F.when(F.col("_level") <= share, F.col("_level")), F.when(F.col("_level") <= share, F.col("_i")))
    common = levels.withColumn("_common", first.over(whole))
    filled = F.when(F.col("_common").isNull(), F.col(cap)).otherwise(
        F.least(F.col(mag) * F.col("_common"), F.col(cap))
    )
    return common.withColumn(out, F.greatest(filled, F.lit(0.0))).drop("_level", "_i", "_common")


def cap_and_redistribute(df: DataFrame, group: Sequence[str], weight: str, cap: float) -> DataFrame:
    """Clip magnitudes to ``cap`` and hand the excess to names with headroom, side by side.

    The excess goes in proportion to headroom, which can never overshoot, so one pass is
    final. Gross and the long/short split are kept as long as there is room.
    """
    if cap <= 0:
        return df
    size = F.abs(weight)
    side = Window.partitionBy(*group, F.signum(weight))
    spare = F.greatest(F.lit(cap) - size, F.lit(0.0))
    excess = F.sum(F.greatest(size - F.lit(cap), F.lit(0.0))).over(side)
    room = F.sum(spare).over(side)
    given = F.coalesce(F.least(spare, excess * ratio(spare, room)), F.lit(0.0))
    return df.withColumn(weight, F.signum(weight) * (F.least(size, F.lit(cap)) + given))


def select_names(
    signal: DataFrame,
    cfg: ConstructionConfig,
    *,
    tie_code: Column | None = None,
) -> DataFrame:
    """``(date, symbol, base, k, n_candidates)``: top and bottom names with equal base weight."""
    limit = F.col("group_n") if cfg.long_only else F.floor(F.col("group_n") / 2)
    picked = select_tails(
        signal, ["date"], "value", "symbol", F.least(F.lit(cfg.top_n), limit),
        tie_code=tie_code, max_groups=MAX_SESSIONS, sides=(1,) if cfg.long_only else (-1, 1),
    )
    unit = F.lit(1.0 if cfg.long_only else 0.5)
    return picked.select(
        "date",
        "symbol",
        (F.col("side") * unit / F.col("tail_n")).alias("base"),
        F.col("tail_n").alias("k"),
        F.col("group_n").alias("n_candidates"),
    )


def name_caps(selected: DataFrame, adv: DataFrame, cfg: ConstructionConfig) -> DataFrame:
    """Add ``adv``, ``cap`` and ``adv_bound``: the name limit tightened by participation."""
    top = F.lit(cfg.max_weight if cfg.max_weight > 0 else float("inf"))
    joined = selected.join(adv.select("date", "symbol", "adv"), ["date", "symbol"], "left")
    if cfg.adv_cap < 1.0 and cfg.notional > 0:
        limit = F.when(priced(F.col("adv")), F.lit(cfg.adv_cap) * F.col("adv") / F.lit(cfg.notional))
    else:
        limit = F.lit(None).cast("double")
    return joined.withColumns(
        {"cap": F.least(top, limit), "adv_bound": F.coalesce(limit < top, F.lit(False))}
    )


def project_legs(capped: DataFrame, mapping: DataFrame, cfg: ConstructionConfig) -> DataFrame:
    """Meet name caps, sector caps and leg gross together: sectors first, then names.

    A sector may hold the sum of its members' caps and at most ``sector_cap`` of the leg; a
    single-sector leg has nothing to spread, so the sector cap is inert there.
    """
    target = cfg.leverage if cfg.long_only else cfg.leverage / 2.0
    names = capped.join(mapping.select("symbol", "sector"), "symbol", "left").withColumns(
        {
            "sector": F.coalesce("sector", F.lit("NA")),
            "leg": F.signum("base").cast("int"),
            "mag": F.abs("base"),
        }
    )
    names = stage(names, "legs")
    leg = ["date", "leg"]
    by_sector = names.groupBy(*leg, "sector").agg(F.sum("mag").alias("s_mag"), F.sum("cap").alias("s_sum"))
    several = F.count(F.lit(1)).over(Window.partitionBy(*leg)) > 1
    ceiling = F.lit(cfg.sector_cap * target) if 0.0 < cfg.sector_cap < 1.0 else F.lit(None).cast("double")
    sized = by_sector.withColumns(
        {"s_cap": F.least("s_sum", F.when(several, ceiling)), "s_target": F.lit(target)}
    )
    allotted = water_fill(sized, leg, "s_mag", "s_cap", "s_target", "allot").withColumn(
        "capacity", F.sum("s_cap").over(Window.partitionBy(*leg))
    )
    parts = names.join(allotted.select(*leg, "sector", "allot", "capacity"), [*leg, "sector"])
    filled = water_fill(parts, [*leg, "sector"], "mag", "cap", "allot", "fill")
    return filled.withColumns(
        {
            "weight": F.col("leg") * F.col("fill"),
            "leg_target": F.lit(target),
            "feasible": F.col("capacity") >= F.lit(target - 1e-9),
        }
    )


def balance_legs(projected: DataFrame, cfg: ConstructionConfig) -> DataFrame:
    """Trim the larger leg to the smaller one so the book stays neutral."""
    if cfg.long_only:
        return projected.withColumn("balanced", F.lit(True))
    day = Window.partitionBy("date")
    long = F.sum(F.greatest("weight", F.lit(0.0))).over(day)
    short = F.sum(F.greatest(-F.col("weight"), F.lit(0.0))).over(day)
    legs = projected.withColumns({"_long": long, "_short": short})
    smaller = F.least("_long", "_short")
    uneven = (F.abs(F.col("_long") - F.col("_short")) > 1e-12) & (smaller > 0)
    own = F.when(F.col("weight") > 0, F.col("_long")).otherwise(F.col("_short"))
    return legs.withColumns(
        {
            "weight": F.when(uneven & (own > smaller), F.col("weight") * smaller / own).otherwise(F.col("weight")),
            "balanced": ~uneven,
        }
    ).drop("_long", "_short")


#: What the fold of a name's weights tells of a decision date.
CARRIED = "symbol string, k int, prev_weight double, weight double, candidate boolean, banded boolean"
OPENING = -1


def _fold_weights(band: float):
    """A pass over rows sorted by (symbol, k) that lets every name's weight follow from its last one.

    A row is a date on which the name is a candidate. A held name that is none on the next date is sold
    on it. Only the current name is in memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held, last, end = None, 0.0, OPENING, OPENING
        out: list[tuple] = []

        def leave() -> None:
            if abs(held) > HELD and last < end:
                out.append((name, last + 1, held, 0.0, False, False))

        def handed() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = (pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.bool_(), pa.bool_())
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["symbol", "k", "prev_weight", "weight", "candidate", "banded"])

        for batch in batches:
            for symbol, k, target, end_k in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                if symbol != name:
                    leave()
                    name, held, last = symbol, 0.0, OPENING
                end = end_k
                if k == OPENING:
                    held = target
                    continue
                if k > last + 1:
                    leave()
                    held = 0.0
                prev = held if abs(held) > HELD else 0.0
                calm = abs((target or 0.0) - prev) < band
                held, last = prev if calm else target or 0.0, k
                if target is not None or prev != 0.0:
                    out.append((symbol, k, prev, held, True, calm))
            yield handed()
        leave()
        yield handed()

    return run


def carry_weights(target: DataFrame, live: DataFrame, band: float, opening: DataFrame | None = None) -> DataFrame:
    """``(date, symbol, prev_weight, weight, candidate, banded)`` of all decision dates in order.

    Every date's book starts from the one that the date before left: ``target`` (date, symbol, weight) is
    what each date wants, ``live`` (date, symbol) its candidates, ``opening`` (symbol, weight) the book in
    force before the first. A name moves only if it would move by ``band`` or more, and one that is no
    longer a candidate is sold. Names do not depend on each other, so one sort by (symbol, date) serves
    all of them and no date waits for another.
    """
    dates = target.select("date").distinct()
    count = F.count(F.lit(1)).over(Window.partitionBy())  # calendar days only
    days = stage(dates.select("date", (F.row_number().over(Window.orderBy("date")) - 1).cast("int").alias("k"), (count - 1).cast("int").alias("_end")), "days")
    wanted = target.select("date", "symbol", F.col("weight").cast("double").alias("_target"))
    ever = target.select("symbol") if opening is None else target.select("symbol").unionByName(opening.select("symbol"))
    rows = (
        live.select("date", "symbol")
        .join(ever.distinct(), "symbol", "left_semi")
        .join(wanted, ["date", "symbol"], "left")
        .join(broadcast_if_bounded(days, MAX_SESSIONS), "date")
        .select("symbol", "k", "_target", "_end")
    )
    if opening is not None:
        end = days.select("_end").limit(1)
        first = opening.select("symbol", F.lit(OPENING).alias("k"), F.col("weight").cast("double").alias("_target"))
        rows = rows.unionByName(first.withColumn("_end", F.coalesce(F.lit(end.scalar()), F.lit(OPENING))))
    sorted_ = rows.repartition("symbol").sortWithinPartitions("symbol", "k")
    folded = sorted_.mapInArrow(_fold_weights(band), CARRIED)
    return folded.join(broadcast_if_bounded(days.select("date", "k"), MAX_SESSIONS), "k").drop("k")


@dataclass
class Book:
    """Frames of a construction run, keyed by decision date."""

    positions: DataFrame  # date, symbol, prev_weight, weight, candidate, sector, adv
    holdings: DataFrame
    trades: DataFrame
    checks: DataFrame


def build_book(
    signal: DataFrame,
    adv: DataFrame,
    mapping: DataFrame,
    cfg: ConstructionConfig,
    costs: CostConfig,
    *,
    prior: DataFrame | None = None,
    carry: bool = False,
    opening: DataFrame | None = None,
    tie_code: Column | None = None,
) -> Book:
    """Portfolio, trades and constraint checks for every date of ``signal``.

    ``prior`` holds ``(date, symbol, prev_weight)``: the book in force before each decision. With ``carry``
    each date starts from the book of the date before, the first from ``opening`` (symbol, weight).
    """
    live = stage(signal.select("date", "symbol", "value").filter(F.col("value").isNotNull()), "signal")
    capped = name_caps(select_names(live, cfg, tie_code=tie_code), adv, cfg)
    fresh = balance_legs(project_legs(capped, mapping, cfg), cfg)
    target = stage(
        fresh.select(
            "date", "symbol", "weight", "sector", "adv", "adv_bound", "capacity", "feasible", "balanced", "leg", "leg_target"
        ),
        "target",
    )
    if carry:
        moved = carry_weights(target, live, cfg.band, opening)
        positions = _described(target.drop("weight").join(moved, ["date", "symbol"], "right"), mapping, adv)
    else:
        positions = _banded(_with_prior(target, live, mapping, adv, prior), cfg.band)
    book = stage(positions, "book")
    holdings = book.filter(F.abs("weight") > HELD).select("date", "symbol", "weight", "sector", "adv")
    sector_count = (
        live.join(mapping.select("symbol", "sector"), "symbol", "left")
        .groupBy("date")
        .agg(F.count_distinct(F.coalesce("sector", F.lit("NA"))).alias("n_sectors"))
    )
    return Book(book, holdings, trade_list(book, cfg, costs), check_book(book, sector_count, cfg))


def _described(positions: DataFrame, mapping: DataFrame, adv: DataFrame) -> DataFrame:
    """Sector and traded value of names that are held but were not selected."""
    return (
        positions.join(mapping.select("symbol", F.col("sector").alias("_sector")), "symbol", "left")
        .join(adv.select("date", "symbol", F.col("adv").alias("_adv")), ["date", "symbol"], "left")
        .withColumns({"sector": F.coalesce("sector", "_sector", F.lit("NA")), "adv": F.coalesce("adv", "_adv")})
        .drop("_sector", "_adv")
    )


def _with_prior(target: DataFrame, live: DataFrame, mapping: DataFrame, adv: DataFrame, prior: DataFrame | None) -> DataFrame:
    """The targets next to the book before each decision, exits included."""
    if prior is None:
        return target.withColumns({"prev_weight": F.lit(0.0), "candidate": F.lit(True)})
    still = live.select("date", "symbol", F.lit(True).alias("candidate"))
    before = (
        prior.select("date", "symbol", "prev_weight")
        .filter(F.abs("prev_weight") > HELD)
        .join(still, ["date", "symbol"], "left")
        .withColumn("candidate", F.coalesce("candidate", F.lit(False)))
    )
    merged = target.join(before, ["date", "symbol"], "full_outer").withColumn("candidate", F.coalesce("candidate", F.lit(True)))
    filled = {c: F.coalesce(c, F.lit(0.0)) for c in ("prev_weight", "weight")}
    # a book is only decided on dates that carry a signal
    return _described(merged, mapping, adv).withColumns(filled).join(target.select("date").distinct(), "date", "left_semi")


def _banded(positions: DataFrame, band: float) -> DataFrame:
    """Names that would move by less than ``band`` stay; those that are no candidates any more are sold."""
    calm = F.col("candidate") & (F.abs(F.col("weight") - F.col("prev_weight")) < F.lit(band))
    final = F.when(calm, F.col("prev_weight")).otherwise(F.col("weight"))
    return positions.withColumns({"banded": calm, "weight": F.when(F.col("candidate"), final).otherwise(F.lit(0.0))})


def trade_list(book: DataFrame, cfg: ConstructionConfig, costs: CostConfig) -> DataFrame:
    """Trades from the prior to the final book, exits of vanished names included."""
    delta = F.col("weight") - F.col("prev_weight")
    moved = book.withColumn("delta_weight", delta).filter(F.abs("delta_weight") > HELD)
    value = F.abs("delta_weight") * F.lit(cfg.notional)
    usable = F.when(priced(F.col("adv")), F.col("adv"))
    buy = F.col("delta_weight") > 0
    fixed = F.lit(1e4) * fixed_cost(F.when(buy, value).otherwise(0.0), F.when(~buy, value).otherwise(0.0), costs) / value
    return moved.select(
        "date",
        "symbol",
        "prev_weight",
        F.col("weight").alias("target_weight"),
        "delta_weight",
        F.when(buy, "BUY").otherwise("SELL").alias("side"),
        usable.alias("adv"),
        ratio(value, usable).alias("participation"),
        (fixed + impact_bps(value, F.col("adv"), costs)).alias("cost_bps"),
    )


def trade_totals(trades: DataFrame) -> DataFrame:
    return trades.groupBy("date").agg(
        F.sum(F.abs("delta_weight")).alias("turnover"),
        F.sum(F.abs("delta_weight") * F.col("cost_bps")).alias("total_cost_bps"),
        F.count(F.lit(1)).alias("n_trades"),
    )


def check_book(book: DataFrame, sector_count: DataFrame, cfg: ConstructionConfig) -> DataFrame:
    """Verify every declared limit on the final weights and list the ones that fail."""
    own = book.filter("candidate")
    size = F.abs("weight")
    shares = own.groupBy("date", "sector").agg(F.sum(size).alias("_s")).groupBy("date").agg(
        ratio(F.max("_s"), F.sum("_s")).alias("worst_sector_share")
    )
    totals = own.groupBy("date").agg(
        F.sum(size).alias("gross"),
        F.sum("weight").alias("net"),
        F.max(size).alias("max_abs_weight"),
        F.count(F.when(F.col("weight") > HELD, 1)).alias("n_long"),
        F.count(F.when(F.col("weight") < -HELD, 1)).alias("n_short"),
        F.bool_and(F.coalesce("feasible", F.lit(True))).alias("feasible"),
        F.bool_and(F.coalesce("balanced", F.lit(True))).alias("legs_balanced"),
        F.count(F.when(F.col("adv_bound"), 1)).alias("n_adv_bound"),
        F.count(F.when(F.col("leg").isNotNull() & ~priced(F.col("adv")), 1)).alias("n_without_adv"),
        F.count(F.when(F.col("banded"), 1)).alias("n_banded"),
    )
    joined = totals.join(broadcast_if_bounded(shares, MAX_SESSIONS), "date").join(
        broadcast_if_bounded(sector_count, MAX_SESSIONS), "date"
    )
    one_sector = F.col("n_sectors") <= 1
    reached = F.col("feasible") & F.col("legs_balanced")
    checked = joined.withColumns(
        {
            "ok_max_weight": F.col("max_abs_weight") <= F.lit(cfg.max_weight + 1e-9),
            "ok_sector_cap": F.lit(cfg.sector_cap >= 1.0)
            | one_sector
            | (F.coalesce("worst_sector_share", F.lit(0.0)) <= F.lit(cfg.sector_cap + 1e-9)),
            "ok_gross": reached & (F.abs(F.col("gross") - F.lit(cfg.leverage)) <= 1e-6),
            "ok_neutral": F.lit(cfg.long_only) | (F.abs("net") <= 1e-6),
        }
    )
    notes = F.array(
        F.when(F.col("n_without_adv") > 0, "names without ADV"),
        F.when(~F.col("legs_balanced"), "larger leg trimmed"),
        F.when(one_sector & F.lit(0.0 < cfg.sector_cap < 1.0), "sector cap inert"),
        F.when(~F.col("feasible"), "limits cannot absorb the target"),
        F.when(~F.col("ok_max_weight"), "max_weight exceeded"),
        F.when(~F.col("ok_sector_cap"), "sector_cap exceeded"),
        F.when(reached & ~F.col("ok_gross"), "gross off target"),
        F.when(~F.col("ok_neutral"), "not dollar neutral"),
    )
    return checked.withColumn("warnings", F.filter(notes, lambda n: n.isNotNull()))


# -- dated holdings --------------------------------------------------------------------


def save_holdings(holdings: DataFrame, root: str) -> None:
    """Write books partitioned by decision date; rerunning a date replaces that date only."""
    (
        holdings.select("symbol", "weight", F.col("date").alias("as_of"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("as_of")
        .parquet(root)
    )


def load_holdings(spark, root: str, before: str) -> DataFrame:
    """The latest book strictly before a date; empty when there is none."""
    schema = "symbol string, weight double, as_of date"
    stored = spark.read.schema(schema).parquet(root)
    earlier = stored.filter(F.col("as_of") < F.to_date(F.lit(before)))
    return earlier.filter(F.col("as_of") == earlier.agg(F.max("as_of")).scalar())


def holdings_totals(holdings: DataFrame) -> DataFrame:
    return holdings.groupBy("as_of").agg(
        F.sum(F.abs("weight")).alias("gross"), F.sum("weight").alias("net"), F.count(F.lit(1)).alias("n_names")
    )


def carry_forward(decided: DataFrame, sessions: DataFrame) -> DataFrame:
    """Book in force on every session: without a decision the previous book is held.

    ``decided`` holds ``(date, symbol, weight)``. Returns ``(date, as_of, symbol, weight)``.
    """
    days = sessions.join(
        broadcast_if_bounded(decided.select("date").distinct().withColumn("_as_of", F.col("date")), MAX_SESSIONS),
        "date",
        "left",
    )
    held = F.last("_as_of", ignorenulls=True).over(
        Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    )
    in_force = days.select("date", held.alias("as_of")).filter(F.col("as_of").isNotNull())
    return decided.withColumnRenamed("date", "as_of").join(broadcast_if_bounded(in_force, MAX_SESSIONS), "as_of")
