"""Trading-calendar operators over a session dimension ``(date, pos)``.

The dimension holds distinct calendar dates, so its row count is bounded by the number of
days covered (under 40 000 per century). That proof is what allows the un-partitioned
``row_number`` here and the broadcast hints wherever the dimension is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import MAX_SESSIONS, broadcast_if_bounded


def sessions_from(df: DataFrame, date: str = "date") -> DataFrame:
    """Distinct observed dates with their 0-based ordinal."""
    days = df.select(F.col(date).cast("date").alias("date")).filter(F.col("date").isNotNull()).distinct()
    return days.withColumn("pos", (F.row_number().over(Window.orderBy("date")) - 1).cast("int"))


def with_position(df: DataFrame, sessions: DataFrame, date: str = "date", how: str = "inner") -> DataFrame:
    """Attach the session ordinal of a date column."""
    dim = sessions.select(F.col("date").alias(date), "pos")
    return df.join(broadcast_if_bounded(dim, MAX_SESSIONS), date, how)


def day_index(sessions: DataFrame) -> DataFrame:
    """One row per calendar day of the span with session lookups in both directions.

    ``before``/``upto`` count the sessions strictly before / on or before the day, so
    ``pos = upto - 1`` is the previous session (inclusive) and ``pos = before`` the next.
    """
    span = sessions.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias("day"))
    hit = days.join(
        broadcast_if_bounded(sessions.select(F.col("date").alias("day"), "pos"), MAX_SESSIONS), "day", "left"
    )
    order = Window.orderBy("day")
    upto = F.max("pos").over(order.rowsBetween(Window.unboundedPreceding, 0)) + 1
    return hit.select(
        "day",
        F.col("pos").isNotNull().alias("is_session"),
        upto.cast("int").alias("upto"),
        (upto - F.col("pos").isNotNull().cast("int")).cast("int").alias("before"),
    )


def first_session(sessions: DataFrame) -> Column:
    return sessions.agg(F.min("date")).scalar()


def last_session(sessions: DataFrame) -> Column:
    return sessions.agg(F.max("date")).scalar()


def session_count(sessions: DataFrame) -> Column:
    return sessions.agg(F.count(F.lit(1)).cast("int")).scalar()


def place(df: DataFrame, sessions: DataFrame, date: str) -> DataFrame:
    """Attach ``upto`` and ``before``, plus the calendar's end as ``_last_day`` and ``_n_days``.

    Dates outside the calendar get the counts of the nearer end.
    """
    lookup = day_index(sessions).select(F.col("day").alias(date), "upto", "before")
    joined = df.join(broadcast_if_bounded(lookup, MAX_SESSIONS), date, "left").withColumns(
        {"_last_day": last_session(sessions), "_n_days": session_count(sessions)}
    )
    outside = F.when(F.col(date) > F.col("_last_day"), F.col("_n_days")).otherwise(F.lit(0))
    return joined.withColumns(
        {
            "upto": F.coalesce("upto", outside).cast("int"),
            "before": F.coalesce("before", outside).cast("int"),
        }
    )


_PLACED = ("_at", "_hit", "_target", "upto", "before", "_last_day", "_n_days")


def add_weekdays(day: Column, steps: Column) -> Column:
    """``steps`` weekdays after ``day`` (Saturday and Sunday are skipped)."""
    wd = F.weekday(day)
    start = F.when(wd >= 5, F.date_sub(day, (wd - 4).cast("int"))).otherwise(day)
    at = F.least(wd, F.lit(4))
    total = at + steps
    whole = F.floor(total / 5).cast("int")
    moved = F.date_add(start, (whole * 7 + (total - whole * 5) - at).cast("int"))
    return F.when(steps > 0, moved).otherwise(day)


def shift(df: DataFrame, sessions: DataFrame, date: str, n: int, out: str = "shifted") -> DataFrame:
    """Move a date by ``n`` sessions.

    Zero is the identity even off-calendar; forward is the n-th session strictly after and
    extrapolates by weekdays past the end; backward before the start gives NULL.
    """
    if n == 0:
        return df.withColumn(out, F.col(date))
    placed = place(df, sessions, date)
    target = (F.col("upto") + n - 1) if n > 0 else (F.col("before") + n)
    dim = broadcast_if_bounded(
        sessions.select(F.col("pos").alias("_target"), F.col("date").alias("_hit")), MAX_SESSIONS
    )
    moved = placed.withColumn("_target", target.cast("int")).join(dim, "_target", "left")
    if n > 0:
        beyond = F.col(date) >= F.col("_last_day")
        anchor = F.when(beyond, F.col(date)).otherwise(F.col("_last_day"))
        steps = F.when(beyond, F.lit(n)).otherwise(F.col("_target") - (F.col("_n_days") - 1))
        value = F.coalesce(F.col("_hit"), add_weekdays(anchor, steps))
    else:
        value = F.col("_hit")
    return moved.withColumn(out, value).drop(*_PLACED)


def _neighbour(df: DataFrame, sessions: DataFrame, date: str, position: Column, out: str) -> DataFrame:
    dim = broadcast_if_bounded(
        sessions.select(F.col("pos").alias("_at"), F.col("date").alias("_hit")), MAX_SESSIONS
    )
    return place(df, sessions, date).withColumn("_at", position.cast("int")).join(dim, "_at", "left").withColumn(
        out, F.col("_hit")
    )


def next_session(
    df: DataFrame, sessions: DataFrame, date: str, *, inclusive: bool = False, out: str = "next_session"
) -> DataFrame:
    """First session after (or on) a date; past the end the next weekday."""
    found = _neighbour(df, sessions, date, F.col("before") if inclusive else F.col("upto"), out)
    anchor = F.greatest(F.col(date), F.col("_last_day"))
    after = add_weekdays(anchor, F.lit(1))
    if inclusive:
        rolled = F.when(F.weekday(date) >= 5, add_weekdays(F.col(date), F.lit(1))).otherwise(F.col(date))
        after = F.when(F.col(date) > F.col("_last_day"), rolled).otherwise(after)
    return found.withColumn(out, F.coalesce(out, after)).drop(*_PLACED)


def prev_session(
    df: DataFrame, sessions: DataFrame, date: str, *, inclusive: bool = False, out: str = "prev_session"
) -> DataFrame:
    """Last session before (or on) a date; NULL before the calendar starts."""
    position = (F.col("upto") if inclusive else F.col("before")) - 1
    return _neighbour(df, sessions, date, position, out).drop(*_PLACED)


def sessions_between(sessions: DataFrame, start: str | Column, end: str | Column) -> DataFrame:
    lo = F.to_date(F.lit(start)) if isinstance(start, str) else start
    hi = F.to_date(F.lit(end)) if isinstance(end, str) else end
    return sessions.filter((F.col("date") >= lo) & (F.col("date") <= hi))


def count_between(df: DataFrame, sessions: DataFrame, start: str, end: str, out: str = "n_sessions") -> DataFrame:
    """Sessions inside ``[start, end]`` per row, as a difference of two calendar lookups."""
    first = place(df, sessions, start).withColumn("_lo", F.col("before")).drop(*_PLACED)
    last = place(first, sessions, end).withColumn("_hi", F.col("upto")).drop(*_PLACED)
    return last.withColumn(out, F.greatest(F.lit(0), F.col("_hi") - F.col("_lo")).cast("long")).drop("_lo", "_hi")


def holidays(sessions: DataFrame) -> DataFrame:
    """Weekdays of the span without a session."""
    span = sessions.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    weekdays = span.select(F.explode(F.sequence("a", "b")).alias("date")).filter(F.weekday("date") < 5)
    return weekdays.join(broadcast_if_bounded(sessions.select("date"), MAX_SESSIONS), "date", "left_anti")


_PERIODS = {"quarterly": "quarter", "monthly": "month", "annual": "year"}


def rebalance_dates(sessions: DataFrame, freq: str = "quarterly") -> DataFrame:
    """Last session of each period."""
    if freq not in _PERIODS:
        raise ValueError(f"unsupported rebalance frequency {freq!r}")
    return (
        sessions.groupBy(F.date_trunc(_PERIODS[freq], "date").cast("date").alias("period"))
        .agg(F.max("date").alias("rebalance_date"))
        .select("rebalance_date")
    )
