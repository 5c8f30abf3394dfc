"""Sleeves, overlays and water-filling against direct loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.config import BookConfig, CostConfig, DrawdownControl, VolTarget
from tidemark.operators import calendar, portfolio, risk, sharpe, splits
from tidemark.operators import backtest as B
from tidemark.plans import studies

from test_pointintime import day, prices

COSTS = CostConfig(adv_window=4)
BOOK = BookConfig(holding=3, leverage=1.0, notional=1e4, costs=COSTS)


def loop(weights, close, adv, control=None):
    """The book session by session: (gross, net, scale)."""
    n, m = close.shape
    held, rows = np.zeros((3, m)), []
    equity = peak = 1.0
    low = False
    for i in range(n - 1):
        scale = control.derisk_to if control and low else 1.0
        new = weights[i] / 3 * scale
        delta = new - held[i % 3]
        held[i % 3] = new
        buys, sells = delta[delta > 0].sum(), -delta[delta < 0].sum()
        cost = COSTS.buy_rate * buys + COSTS.sell_rate * sells
        for j in np.flatnonzero(delta):
            if adv[i, j] > 0:
                size = abs(delta[j]) * BOOK.notional
                cost += size * COSTS.impact_coef * math.sqrt(size / adv[i, j]) / BOOK.notional
        gross = float((held.sum(axis=0) * (close[i + 1] / close[i] - 1)).sum())
        net = gross - cost
        rows.append((gross, net, scale))
        equity *= 1 + net
        peak = max(peak, equity)
        dd = equity / peak - 1
        if control:
            low = dd < -control.restore_threshold if low else dd <= -control.threshold
    return np.array(rows)


@pytest.fixture(scope="module")
def market(spark):
    px = prices(spark, n=50, symbols=tuple("ABCDEFG"))
    ses = calendar.sessions_from(px)
    rng = np.random.default_rng(5)
    w = rng.normal(size=(50, 7)) / 7
    w[::4] = 0.0
    rows = [("s", s, i, float(w[i, j])) for i in range(50) for j, s in enumerate("ABCDEFG") if w[i, j] != 0]
    targets = spark.createDataFrame(rows, "strategy string, symbol string, pos int, weight double")
    pdf = px.select("date", "symbol", "adj_close", "turnover").toPandas().sort_values(["date", "symbol"])
    close = pdf.pivot(index="date", columns="symbol", values="adj_close").values
    turn = pdf.pivot(index="date", columns="symbol", values="turnover")
    adv = turn.shift(1).rolling(4, min_periods=2).mean().fillna(0.0).values
    return px, ses, targets, w, close, adv


def test_closed_form_sleeves_equal_the_loop(market):
    px, ses, targets, w, close, adv = market
    got = B.at_notional(B.run_backtest(targets, px, ses, BOOK), [BOOK.notional]).orderBy("pos").toPandas()
    want = loop(w, close, adv)
    np.testing.assert_allclose(got.gross_return, want[:, 0], atol=1e-12)
    np.testing.assert_allclose(got.net_return, want[:, 1], atol=1e-12)


def test_drawdown_control_equals_the_loop(market):
    px, ses, targets, w, close, adv = market
    control = DrawdownControl(True, 0.03, 0.5, 0.01)
    daily = studies.overlay_run(targets, px, ses, BOOK, VolTarget(), control, 1)
    got = B.at_notional(daily, [BOOK.notional]).orderBy("pos").toPandas()
    want = loop(w, close, adv, control)
    assert set(want[:, 2]) == {0.5, 1.0}
    np.testing.assert_allclose(got.scale, want[:, 2])
    np.testing.assert_allclose(got.net_return, want[:, 1], atol=1e-12)


def test_volatility_scale_uses_only_the_past(market):
    px, ses, targets, *_ = market
    daily = B.run_backtest(targets, px, ses, BOOK).select("strategy", "pos", "unit_return")
    cfg = VolTarget(True, "absolute", 0.1, window=6, min_obs=6)
    base = {r.pos: r.scale for r in risk.volatility_scale(daily, cfg).collect()}
    bumped = daily.withColumn("unit_return", F.when(F.col("pos") >= 20, F.col("unit_return") * 9).otherwise(F.col("unit_return")))
    moved = {r.pos: r.scale for r in risk.volatility_scale(bumped, cfg).collect()}
    assert all(base[i] == moved[i] for i in range(21)) and base[23] != moved[23]
    assert all(base[i] == 1.0 for i in range(6))


def brute_fill(mag, cap, target):
    level = (0.0, 1e6)
    for _ in range(200):
        mid = sum(level) / 2
        level = (mid, level[1]) if np.minimum(mag * mid, cap).sum() < target else (level[0], mid)
    return np.minimum(mag * level[1], cap)


def test_water_fill_against_bisection(spark):
    rng = np.random.default_rng(11)
    rows, want = [], {}
    for g in range(60):
        k = int(rng.integers(1, 9))
        mag, cap = rng.random(k) + 0.05, rng.random(k) * 0.5 + 0.01
        target = float(rng.random() * 2)
        for i, (a, b) in enumerate(zip(mag, cap)):
            rows.append((g, i, float(a), float(b), target))
        fills = cap if cap.sum() <= target else brute_fill(mag, cap, target)
        want |= {(g, i): f for i, f in enumerate(fills)}
    df = spark.createDataFrame(rows, "g int, i int, mag double, cap double, target double")
    got = {(r.g, r.i): r.x for r in portfolio.water_fill(df, ["g"], "mag", "cap", "target", "x").collect()}
    assert max(abs(got[k] - want[k]) for k in want) < 1e-9


def test_plain_fold_would_leak(spark):
    ses = calendar.sessions_from(spark.createDataFrame([(day(i),) for i in range(60)], "date date"))
    folds = splits.purged_folds(ses, 4, horizon=5, embargo=2)
    assert all(r.clean for r in splits.leakage_check(folds, 5).collect())
    unpurged = folds.withColumn("role", F.when(F.col("role") != "test", "train").otherwise("test"))
    assert not any(r.clean for r in splits.leakage_check(unpurged, 5).collect())


def test_sharpe_of_constant_series_is_null(spark):
    rows = [("flat", i, 0.001) for i in range(100)] + [("one", 0, 0.5)]
    df = spark.createDataFrame(rows, "strategy string, pos int, ret double")
    assert all(r.sharpe_period is None for r in sharpe.sharpe(df, ["strategy"], "ret").collect())


def test_overfitting_detects_a_dominant_configuration(spark):
    rng = np.random.default_rng(2)
    rows = []
    for c, drift in (("good", 1.0), ("a", 0.0), ("b", 0.0), ("c", 0.0)):
        rows += [(c, i, float(drift + rng.normal())) for i in range(64)]
    df = spark.createDataFrame(rows, "strategy string, pos int, ret double")
    out = sharpe.overfitting_probability(sharpe.split_logits(sharpe.right_align(df, "strategy", "ret"), n_partitions=8)).first()
    assert out.n_splits == 70 and out.pbo < 0.1


def test_variants_share_the_names_of_one_pass(market, spark):
    px, ses, targets, w, close, adv = market
    control = DrawdownControl(True, 0.03, 0.5, 0.01)
    variants = {"none": (VolTarget(), DrawdownControl()), "drawdown": (VolTarget(), control)}
    got = {r.variant: r for r in studies.overlay_grid(targets, px, ses, BOOK, variants, 1).collect()}
    for name, on in (("none", None), ("drawdown", control)):
        want = loop(w, close, adv, on)
        assert got[name].net_annual_return == pytest.approx(want[:, 1].mean() * 252, abs=1e-9)
    # Nothing is moved by name once variants part from each other.
    weights, names = studies._weights(targets, px, ses, BOOK)
    scales = names.select("strategy", F.explode(F.sequence(F.lit(0), F.lit(48))).alias("pos"), F.lit(0.5).alias("scale"))
    both = scales.withColumn("variant", F.lit("a")).unionByName(scales.withColumn("variant", F.lit("b")))
    sized = B.scaled_weights(weights, both, BOOK.holding, max_rows=1000)
    assert sized.filter("variant = 'b'").count() == weights.count() and "symbol" not in sized.columns


def test_a_backtest_selects_its_targets_once(market, monkeypatch):
    px, ses, targets, *_ = market
    held = []
    monkeypatch.setattr(B, "stage", lambda df, purpose="stage": held.append(purpose) or df)
    B.run_backtest(targets, px, ses, BOOK)
    assert held == ["targets"]
