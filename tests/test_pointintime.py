"""Look-ahead injection, gaps and calendar edges on hand-made panels."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.config import FactorConfig, RegimeConfig
from tidemark.operators import asof, calendar, factors, flowfeatures, labels, panel, windows

START = dt.date(2021, 1, 4)


def day(i):
    return START + dt.timedelta(days=7 * (i // 5) + i % 5)


def prices(spark, n=60, symbols=("AAA", "BBB", "CCC"), change_after=None, gap=()):
    rows = []
    for j, s in enumerate(symbols):
        for i in range(n):
            if (s, i) in gap:
                continue
            p = 100.0 + 10 * j + ((i * (j + 3)) % 17)
            if change_after is not None and i > change_after:
                p *= 1.5 + j
            rows.append((day(i), s, p, p, p, p, p, 1000.0 + 13 * i + j))
    raw = spark.createDataFrame(rows, "date date, symbol string, open double, high double, low double, close double, adj_close double, volume double")
    return panel.canonical_prices(raw)


LIBRARY = factors.default_library(FactorConfig(10, 2, (3, 5), 8, 5, 5, 5))


def test_factors_ignore_the_future(spark):
    cut = day(40)
    out = []
    for change in (None, 40):
        px = prices(spark, change_after=change)
        long = factors.factor_long(px, calendar.sessions_from(px), LIBRARY).filter(F.col("date") <= cut)
        out.append({(r.factor, r.date, r.symbol): r.value for r in long.collect()})
    assert out[0] == out[1] and out[0]


def test_labels_do_see_the_future(spark):
    a, b = (prices(spark, change_after=c) for c in (None, 40))
    first = labels.forward_returns(a, calendar.sessions_from(a), [5]).filter(F.col("date") == day(40)).orderBy("symbol")
    second = labels.forward_returns(b, calendar.sessions_from(b), [5]).filter(F.col("date") == day(40)).orderBy("symbol")
    assert [r.fwd_5 for r in first.collect()] != [r.fwd_5 for r in second.collect()]


def test_flow_features_ignore_the_future_and_today(spark):
    def build(change):
        rows = []
        for i in range(80):
            for k, who in enumerate(("FII", "DII", "Client")):
                v = float(((i * 7 + k * 3) % 23) - 11) + (1000.0 if change and i >= 50 else 0.0)
                rows.append((day(i), who, v))
        flows = spark.createDataFrame(rows, "date date, participant string, net_futures double")
        feats = flowfeatures.flow_features(flows, calendar.sessions_from(flows), RegimeConfig(window=5, min_obs=20))
        return {r.date: r for r in feats.collect()}

    plain, poisoned = build(False), build(True)
    # session 50 may only know flows through session 49
    for i in range(51):
        assert plain[day(i)] == poisoned[day(i)]
    assert plain[day(52)] != poisoned[day(52)]


def test_gap_gives_null_label_and_no_grid_return(spark):
    px = prices(spark, gap={("AAA", 10)})
    ses = calendar.sessions_from(px)
    fwd = {(r.symbol, r.date): r.fwd_1 for r in labels.forward_returns(px, ses, [1]).collect()}
    assert fwd[("AAA", day(9))] is None and fwd[("BBB", day(9))] is not None
    grid = {(r.symbol, r.pos): r.ret for r in factors.factor_grid(px, ses).collect()}
    assert grid[("AAA", 10)] is None and grid[("AAA", 11)] is None and grid[("AAA", 12)] is not None
    rows = {(r.symbol, r.date): r.ret for r in windows.row_returns(px).collect()}
    assert rows[("AAA", day(11))] is not None


def test_momentum_by_hand(spark):
    px = prices(spark)
    ses = calendar.sessions_from(px)
    got = {r.date: r.value for r in factors.factor_long(px, ses, [factors.Momentum(10, 2)]).filter("symbol = 'AAA'").collect()}
    p = [100.0 + (i * 3) % 17 for i in range(60)]
    assert len(got) == 48
    assert got[day(20)] == pytest.approx(p[18] / p[8] - 1)


def test_refused_arguments(spark):
    with pytest.raises(ValueError):
        windows.shifted("x", -1)
    with pytest.raises(ValueError):
        labels.forward_returns(prices(spark), None, [0])
    with pytest.raises(asof.LookAheadError):
        asof.Registry().get("nothing")
    with pytest.raises(asof.LookAheadError):
        asof.Dataset("undeclared").require_lag()
    flows = asof.Dataset("flows_daily", entity=None, lag_sessions=1)
    px = prices(spark)
    with pytest.raises(asof.LookAheadError):
        asof.snapshot(px, calendar.sessions_from(px), flows, "2021-02-01", symbols=["AAA"])


def test_shift_edges(spark):
    px = prices(spark, n=10)
    ses = calendar.sessions_from(px)
    rows = spark.createDataFrame([(dt.date(2021, 1, 9),), (day(9),), (day(0),)], "d date")
    got = {r.d: r.shifted for r in calendar.shift(rows, ses, "d", 1).collect()}
    assert got[dt.date(2021, 1, 9)] == dt.date(2021, 1, 11)
    assert got[day(9)] == dt.date(2021, 1, 18)  # past the end: next weekday
    back = {r.d: r.shifted for r in calendar.shift(rows, ses, "d", -1).collect()}
    assert back[day(0)] is None
    same = {r.d: r.shifted for r in calendar.shift(rows, ses, "d", 0).collect()}
    assert same[dt.date(2021, 1, 9)] == dt.date(2021, 1, 9)


def test_snapshot_never_reveals_unpublished_rows(spark):
    px = prices(spark, n=20)
    ses = calendar.sessions_from(px)
    lagged = asof.Dataset("lagged", lag_sessions=2)
    for i in (1, 5, 12):
        last = asof.snapshot(px, ses, lagged, str(day(i))).agg(F.max("date")).first()[0]
        assert last == (day(i - 2) if i >= 2 else None)
