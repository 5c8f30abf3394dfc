"""Point-in-time reads: no row is visible before the session it became public."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import MAX_SESSIONS, broadcast_if_bounded
from .calendar import shift, with_position


class LookAheadError(ValueError):
    """A read that would reveal the future, or whose lag is undeclared."""


@dataclass(frozen=True)
class Dataset:
    """A registered table and the delay after which its rows are public.

    Exactly one of ``lag_sessions`` and ``lag_days`` is set; a dataset without a declared
    lag cannot be read.
    """

    name: str
    date: str = "date"
    entity: str | None = "symbol"
    lag_sessions: int | None = None
    lag_days: int | None = None
    path: str | None = None

    def require_lag(self) -> None:
        if (self.lag_sessions is None) == (self.lag_days is None):
            raise LookAheadError(f"dataset {self.name!r} needs exactly one availability lag")


#: Published availability delays of the standard datasets (fixed values).
STANDARD = (
    Dataset("prices", lag_sessions=0),
    Dataset("flow_features", entity=None, lag_sessions=0),
    Dataset("flows_daily", entity=None, lag_sessions=1),
    Dataset("participant_flows", entity=None, lag_sessions=1),
    Dataset("fii_dii_cash", entity=None, lag_sessions=1),
    Dataset("bulk_deals", lag_sessions=1),
    Dataset("block_deals", lag_sessions=1),
    Dataset("shareholding", lag_days=21),
)


@dataclass
class Registry:
    """Known datasets; anything else is an error, never a default."""

    datasets: dict[str, Dataset] = field(default_factory=lambda: {d.name: d for d in STANDARD})

    def get(self, name: str) -> Dataset:
        if name not in self.datasets:
            raise LookAheadError(f"unknown dataset {name!r}; known: {sorted(self.datasets)}")
        found = self.datasets[name]
        found.require_lag()
        return found

    def describe(self, spark: SparkSession, root: str | None = None) -> DataFrame:
        """One row per dataset with its lag and whether its table exists under ``root``."""
        rows = []
        for name in sorted(self.datasets):
            d = self.datasets[name]
            lag, unit = (d.lag_sessions, "sessions") if d.lag_sessions is not None else (d.lag_days, "days")
            rows.append((name, lag, unit, d.entity, root is not None and _exists(spark, f"{root}/{d.path or name}")))
        return spark.createDataFrame(rows, "dataset string, lag int, unit string, entity string, present boolean")


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def load(spark: SparkSession, path: str, dataset: Dataset) -> DataFrame:
    """Parquet scan of a registered dataset with its event date typed as a date."""
    df = spark.read.parquet(path)
    if dataset.date not in df.columns:
        raise LookAheadError(f"dataset {dataset.name!r} has no event-date column {dataset.date!r}")
    return df.withColumn(dataset.date, F.col(dataset.date).cast("date"))


def available_from(df: DataFrame, sessions: DataFrame, dataset: Dataset, out: str = "available_from") -> DataFrame:
    dataset.require_lag()
    if dataset.lag_days is not None:
        return df.withColumn(out, F.date_add(dataset.date, dataset.lag_days))
    return shift(df, sessions, dataset.date, dataset.lag_sessions, out)


def cutoff(sessions: DataFrame, dataset: Dataset, as_of: str) -> Column:
    """Latest visible event date at ``as_of`` (a scalar subquery; NULL before any data)."""
    dataset.require_lag()
    day = F.to_date(F.lit(as_of))
    if dataset.lag_days is not None:
        return F.date_sub(day, dataset.lag_days)
    if dataset.lag_sessions == 0:
        return day
    seen = sessions.filter(F.col("date") <= day)
    anchor = seen.agg(F.max("pos").alias("_p")).select(F.col("_p") - dataset.lag_sessions)
    return sessions.filter(F.col("pos") == anchor.scalar()).agg(F.max("date")).scalar()


def cutoffs(queries: DataFrame, sessions: DataFrame, dataset: Dataset, as_of: str = "as_of") -> DataFrame:
    """:func:`cutoff` for a table of query dates (adds ``cutoff``)."""
    dataset.require_lag()
    if dataset.lag_days is not None:
        return queries.withColumn("cutoff", F.date_sub(as_of, dataset.lag_days))
    if dataset.lag_sessions == 0:
        return queries.withColumn("cutoff", F.col(as_of))
    from .calendar import _PLACED, place

    dim = sessions.select(F.col("pos").alias("_at"), F.col("date").alias("cutoff"))
    placed = place(queries, sessions, as_of).withColumn("_at", F.col("upto") - 1 - dataset.lag_sessions)
    return placed.join(broadcast_if_bounded(dim, MAX_SESSIONS), "_at", "left").drop(*_PLACED)


def snapshot(
    df: DataFrame,
    sessions: DataFrame,
    dataset: Dataset,
    as_of: str,
    *,
    fields: Sequence[str] | None = None,
    lookback: int | None = None,
    symbols: Sequence[str] | DataFrame | None = None,
) -> DataFrame:
    """The dataset exactly as it stood at ``as_of``.

    ``lookback`` counts sessions, not rows. The cut-off becomes one date predicate, so it
    reaches the scan of a table stored by date.
    """
    last = cutoff(sessions, dataset, as_of)
    out = df.filter(F.col(dataset.date) <= last)
    if lookback is not None:
        if lookback <= 0:
            raise ValueError("lookback must be a positive number of sessions")
        visible = sessions.filter(F.col("date") <= last)
        first = visible.filter(
            F.col("pos") > visible.agg(F.max("pos")).scalar() - lookback
        ).agg(F.min("date")).scalar()
        out = out.filter(F.col(dataset.date) >= F.coalesce(first, F.col(dataset.date)))
    if symbols is not None:
        if dataset.entity is None:
            raise LookAheadError(f"dataset {dataset.name!r} is an aggregate series without entities")
        if isinstance(symbols, DataFrame):
            out = out.join(symbols.select(F.col(symbols.columns[0]).alias(dataset.entity)), dataset.entity, "left_semi")
        else:
            out = out.filter(F.col(dataset.entity).isin(list(symbols)))
    if fields is not None:
        unknown = [f for f in fields if f not in df.columns]
        if unknown:
            raise LookAheadError(f"dataset {dataset.name!r}: unknown fields {unknown}; has {df.columns}")
        keys = [c for c in (dataset.entity, dataset.date) if c]
        out = out.select(*dict.fromkeys([*keys, *fields]))
    return out


def latest_by_entity(
    df: DataFrame,
    sessions: DataFrame,
    dataset: Dataset,
    queries: DataFrame,
    as_of: str = "as_of",
) -> DataFrame:
    """For every query date and entity the newest row already public (bulk as-of read).

    A row answers the query dates from its own availability up to the next row's. Query dates are
    numbered, so a row looks up two numbers and is expanded to what lies between them; it neither
    carries nor scans the other dates.
    """
    if dataset.entity is None:
        raise LookAheadError(f"dataset {dataset.name!r} has no entity column")
    public = available_from(df, sessions, dataset, "_from")
    w = Window.partitionBy(dataset.entity).orderBy("_from", dataset.date)
    spans = public.withColumn("_until", F.lead("_from").over(w))
    asked = queries.select(F.col(as_of).cast("date").alias(as_of)).filter(F.col(as_of).isNotNull()).distinct()
    asked = asked.withColumn("_q", (F.row_number().over(Window.orderBy(as_of)) - 1).cast("int"))  # a row per calendar day
    marks = spans.select(F.col("_from").alias("_day"), F.lit(0).alias("_n")).filter(F.col("_day").isNotNull()).distinct()
    marks = marks.unionByName(asked.select(F.col(as_of).alias("_day"), F.lit(1).alias("_n")))
    earlier = Window.orderBy(F.unix_date("_day")).rangeBetween(Window.unboundedPreceding, -1)
    place = marks.withColumn("_at", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).cast("int"))
    place = place.groupBy("_day").agg(F.max("_at").alias("_at"))
    first = place.select(F.col("_day").alias("_from"), F.col("_at").alias("_lo"))
    end = place.select(F.col("_day").alias("_until"), F.col("_at").alias("_hi"))
    placed = spans.join(first, "_from").join(end, "_until", "left")
    placed = placed.withColumn("_hi", F.coalesce("_hi", asked.agg(F.count(F.lit(1)).cast("int")).scalar()))
    spread = placed.filter("_hi > _lo").withColumn("_q", F.explode(F.sequence("_lo", F.col("_hi") - 1)))
    return spread.join(asked, "_q").drop("_from", "_until", "_lo", "_hi", "_q")


def membership(df: DataFrame, sessions: DataFrame) -> DataFrame:
    """Session ordinal per row, NULL for dates that are no session."""
    return with_position(df, sessions, how="left")
