"""The daily run: no look-ahead, and the same books however sessions are dealt to batches."""

import pytest
from pyspark.sql import functions as F

from tidemark.config import CompositeConfig, ConstructionConfig, CostConfig, FactorConfig, RegimeConfig
from tidemark.operators import calendar, factors, flowfeatures, formula, windows
from tidemark.session import stage
from tidemark.streaming import incremental
from tidemark.streaming.desk import DailyDesk

from test_pointintime import LIBRARY, day, prices

N, CUT, SYMBOLS = 90, 70, tuple(f"S{i}" for i in range(9))
REGIME = RegimeConfig(window=4, min_obs=12)


def features(spark, sessions, change):
    rows = []
    for i in range(N):
        for k, who in enumerate(("FII", "DII", "Client")):
            rows.append((day(i), who, float(((i * 7 + k * 3) % 23) - 11) + (500.0 if change is not None and i > change else 0.0)))
    flows = spark.createDataFrame(rows, "date date, participant string, net_futures double")
    return flowfeatures.flow_features(flows, sessions, REGIME)


def desk(spark, change=None):
    px = stage(prices(spark, n=N, symbols=SYMBOLS, change_after=change, gap={("S3", i) for i in range(40, 55)}), "px")
    sessions = stage(calendar.sessions_from(px), "sessions")
    panel = stage(factors.build_panels(px, sessions, LIBRARY, FactorConfig(10, 2, (3, 5), 8, 5, 5, 5)), "panel")
    sectors = spark.createDataFrame([(s, "odd" if i % 2 else "even") for i, s in enumerate(SYMBOLS[:-1])], "symbol string, sector string")
    return DailyDesk(
        sessions, px, panel, stage(flowfeatures.regime_labels(features(spark, sessions, change)), "labels"), stage(windows.average_daily_value(px, 5), "adv"), sectors,
        CompositeConfig("ic_ir", window=25, horizon=3, min_coverage=1), REGIME, ConstructionConfig(top_n=3, max_weight=0.3, sector_cap=0.8, band=0.02, notional=1e5), CostConfig(adv_window=5), 3,
    )


def run(spark, desk, parts, root):
    for a, b in parts:
        own = desk.sessions.filter(F.col("pos").between(a, b)).select("date")
        own.coalesce(1).write.mode("append").parquet(f"{root}/in")
    arrivals = incremental.file_stream(spark, f"{root}/in", "date date", files_per_batch=1)
    found = incremental.daily_decisions(spark, arrivals, desk, f"{root}/out", f"{root}/state")
    return sorted((r.date, r.symbol, round(r.prev_weight, 9), round(r.weight, 9), r.banded, r.decided) for r in found.collect())


@pytest.fixture(scope="module")
def plain(spark, tmp_path_factory):
    return run(spark, desk(spark), [(0, CUT)], str(tmp_path_factory.mktemp("plain")))


def test_later_sessions_change_no_decision(spark, tmp_path, plain):
    assert plain and {r[0] for r in plain if r[3]} and run(spark, desk(spark, CUT), [(0, CUT)], str(tmp_path)) == plain


def test_batches_of_any_size_leave_the_same_books(spark, tmp_path, plain):
    own = desk(spark)
    # The last file brings sessions that were decided before: they are not decided again.
    assert run(spark, own, [(0, 33), (34, 34), (35, CUT), (20, 30)], str(tmp_path)) == plain
    books = {}
    for date, symbol, prev, weight, _, _ in plain:
        books.setdefault(date, {})[symbol] = (prev, weight)
    held = {}
    for date in sorted(books):
        assert {s: p for s, (p, _) in books[date].items() if p} == held
        held = {s: w for s, (_, w) in books[date].items() if w}


def test_formulas_ignore_the_future(spark):
    batch = [("close", "tsrank5", "rank"), ("returns", "std10", "zscore", "neg"), ("volume", "mean5", "fii_flow", "mul"), ("close", "delta5", "delay5")]
    out = []
    for change in (None, CUT):
        px = prices(spark, n=N, symbols=SYMBOLS, change_after=change)
        sessions = stage(calendar.sessions_from(px), "sessions")
        base = stage(formula.terminals(factors.factor_grid(px, sessions), features(spark, sessions, change)), "terminals")
        out.append({(r.candidate, r.symbol, r.pos): r.value for r in formula.evaluate(base, batch).filter(F.col("pos") <= CUT).collect()})
    assert out[0] == out[1] and {c for c, _, _ in out[0]} == {0, 1, 2, 3}
