"""Registry of runnable queries with their reference SQL.

A query declares its output as ``"name:kind ..."``; the same declaration shapes the Spark
frame and the SQL. Kinds: a digit rounds a double to that many decimals, ``i`` is BIGINT,
``d`` is DATE, nothing leaves the column alone.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import BookConfig, CompositeConfig, ConstructionConfig, CostConfig, FactorConfig, RegimeConfig
from ..operators import factors as fac
from ..operators import flowfeatures as ff
from ..operators.labels import forward_returns, horizon_long
from ..operators.panel import canonical_prices
from ..session import release_staged, stage
from ..sources import tables
from . import oracle, studies

#: Settings of the registered queries: the panel is weekly, so windows are in weeks.
FACTORS = FactorConfig(
    momentum_lookback=26, momentum_skip=4, reversal_windows=(4, 12), volatility_window=12,
    liquidity_window=8, delivery_window=8, volume_trend_window=8,
)
HORIZONS = (1, 4, 12)
MIN_NAMES = 5
REGIME = RegimeConfig(window=8, min_obs=52)
COSTS = CostConfig(adv_window=8)
BOOK = BookConfig(holding=4, leverage=0.05, notional=1e5, costs=COSTS)
COMPOSITE = CompositeConfig("ic_ir", window=52, horizon=4, min_coverage=3)
CONSTRUCTION = ConstructionConfig(top_n=10, max_weight=0.08, sector_cap=0.25, band=0.01, notional=196_613.0)


class Inputs:
    """Logical tables of one data directory, built on first use within one query."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return tables.read(self.spark, self.sf_dir, name)

    @cached_property
    def bars(self) -> DataFrame:
        return tables.raw_bars(self.spark, self.sf_dir)

    @cached_property
    def px(self) -> DataFrame:
        return canonical_prices(self.bars)

    @cached_property
    def sessions(self) -> DataFrame:
        """The calendar: tiny, read by almost every operator, so derived from the scan once."""
        return stage(tables.ship_sessions(self.spark, self.sf_dir), "sessions")

    @cached_property
    def flows(self) -> DataFrame:
        return tables.participant_flows(self.spark, self.sf_dir)

    @cached_property
    def sectors(self) -> DataFrame:
        return tables.sectors(self.spark, self.sf_dir)

    @cached_property
    def shares(self) -> DataFrame:
        return tables.shares(self.spark, self.sf_dir)

    @cached_property
    def library(self) -> list[fac.Factor]:
        return fac.default_library(FACTORS)

    @cached_property
    def raw_factors(self) -> DataFrame:
        return fac.factor_long(self.px, self.sessions, self.library)

    @cached_property
    def study(self) -> studies.Study:
        return studies.prepare(self.px, self.sessions, self.library, FACTORS, HORIZONS)

    @cached_property
    def study_labels(self) -> DataFrame:
        return horizon_long(forward_returns(self.px, self.sessions, HORIZONS), HORIZONS)

    @cached_property
    def ic(self) -> DataFrame:
        return stage(studies.ic_series(self.study, MIN_NAMES), "ic")

    @cached_property
    def ic4(self) -> DataFrame:
        return stage(studies.composite_ic(self.study, COMPOSITE, MIN_NAMES), "ic")

    @cached_property
    def features(self) -> DataFrame:
        return stage(ff.flow_features(self.flows, self.sessions, REGIME), "features")

    @cached_property
    def labels(self) -> DataFrame:
        return ff.regime_labels(self.features)

    @cached_property
    def targets(self) -> DataFrame:
        return studies.factor_targets(self.study, BOOK, tables.symbol_code())

    @cached_property
    def daily(self) -> DataFrame:
        return stage(
            studies.evaluate_factors(self.study, BOOK, [BOOK.notional], tables.symbol_code()), "daily"
        )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _spec(columns: str) -> list[tuple[str, str]]:
    return [tuple((c.split(":") + [""])[:2]) for c in columns.split()]


def _shape(df: DataFrame, columns: str) -> DataFrame:
    def one(name: str, kind: str):
        c = F.col(name)
        if kind.isdigit():
            c = F.round(c.cast("double"), int(kind)) + F.lit(0.0)
        elif kind == "i":
            c = c.cast("long")
        elif kind == "d":
            c = c.cast("date")
        return c.alias(name)

    return df.select(*[one(n, k) for n, k in _spec(columns)])


def _shape_sql(source: str, columns: str) -> str:
    def one(name: str, kind: str) -> str:
        quoted = f'"{name}"'
        if kind.isdigit():
            return f"{oracle.r(quoted + '::DOUBLE', int(kind))} AS {quoted}"
        if kind == "i":
            return f"{quoted}::BIGINT AS {quoted}"
        if kind == "d":
            return f"{quoted}::DATE AS {quoted}"
        return quoted

    inner = source if " " not in source.strip() else f"({source})"
    return oracle.sql(f"SELECT {', '.join(one(n, k) for n, k in _spec(columns))} FROM {inner} AS result")


def query(name: str, columns: str, source: str | None = None):
    """Register a query; ``source`` is a named sub-query or SELECT for the reference SQL."""

    def add(build: Callable[[Inputs], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            release_staged()
            return _shape(build(Inputs(spark, sf_dir)), columns)

        run.__name__ = name
        QUERIES[name] = run
        if source is not None:
            ORACLES[name] = _shape_sql(source, columns)
        return build

    return add


def load_all() -> None:
    """Import the modules that register queries."""
    from . import q_books, q_formula, q_inference, q_ingest, q_panel, q_signals  # noqa: F401
