"""Scans, order statistics and carried books against one-pass loops."""

import bisect
import datetime as dt
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import paths, ranking
from tidemark.operators import labels, portfolio, sharpe, windows

DAY = dt.date(2020, 1, 1)


def loop(returns):
    """(equity, drawdown, under_run) row by row."""
    equity, peak, run, out = 1.0, None, 0, []
    for r in returns:
        equity *= 1 + r
        peak = equity if peak is None else max(peak, equity)
        run = 0 if equity >= peak else run + 1
        out.append((equity, equity / peak - 1, run))
    return out


@pytest.mark.parametrize("block", [1, 3, 7, 50, 4096])
def test_drawdown_over_blocks(spark, block):
    rng = np.random.default_rng(block)
    series = {"up": rng.normal(0.01, 0.02, 60), "down": rng.normal(-0.01, 0.02, 60), "flat": np.zeros(5), "one": np.array([-0.5]), "mixed": rng.normal(0, 0.05, 200)}
    rows = [(k, 3 * i + (i % 2), float(r)) for k, v in series.items() for i, r in enumerate(v)] + [("up", 1000, None), ("none", 1, None)]
    got = windows.with_drawdown(spark.createDataFrame(rows, "k string, pos int, ret double"), ["k"], "ret", block).toPandas()
    assert list(got.columns) == ["k", "pos", "ret", "equity", "drawdown", "under_run"] and len(got) == sum(map(len, series.values()))
    for k, own in got.sort_values("pos").groupby("k"):
        want = loop(series[k])
        np.testing.assert_allclose(own[["equity", "drawdown"]], [w[:2] for w in want], rtol=1e-9, atol=1e-12)
        assert own.under_run.tolist() == [w[2] for w in want]


def test_summaries_join_like_one_path(spark):
    rng = np.random.default_rng(2)
    returns = rng.normal(0.001, 0.03, 90).tolist()
    for cuts in ([], [1], [30, 31, 60], list(range(1, 90))):
        edges = [0, *cuts, 90]
        parts = [returns[a:b] for a, b in itertools.pairwise(edges)]
        row = spark.createDataFrame([(parts,)], "parts array<array<double>>")
        for metric, want in (
            (paths.MAX_DRAWDOWN, min(w[1] for w in loop(returns))),
            (paths.SORTINO, np.mean(returns) / np.sqrt(np.mean(np.minimum(returns, 0) ** 2))),
        ):
            whole = metric.of_summaries(F.transform("parts", metric.of_returns))
            got = row.select(metric.finish(whole).alias("m")).first().m
            assert got == pytest.approx(want, rel=1e-9)
    none = spark.createDataFrame([([],)], "r array<double>").select(paths.SORTINO.finish(paths.SORTINO.of_returns(F.col("r"))).alias("m"))
    assert none.first().m is None


def test_splits_ranked_by_a_path_metric(spark):
    rng = np.random.default_rng(7)
    matrix = rng.normal(0.0, 0.02, (41, 4))
    rows = [(f"c{j}", i, float(matrix[i, j])) for i in range(41) for j in range(4)]
    aligned = sharpe.right_align(spark.createDataFrame(rows, "strategy string, pos int, ret double"), "strategy", "ret")
    got = {r["mask"]: (r.best, r.omega) for r in sharpe.split_logits(aligned, n_partitions=6, metric=paths.MAX_DRAWDOWN).collect()}
    edges = np.linspace(0, 41, 7).astype(int)
    assert len(got) == 20
    for mask, (best, omega) in got.items():
        side = lambda inside: np.concatenate([np.arange(edges[b], edges[b + 1]) for b in range(6) if (mask >> b & 1) == inside])  # noqa: E731, B023
        score = lambda inside: [min(w[1] for w in loop(matrix[side(inside), j])) for j in range(4)]  # noqa: E731, B023
        chosen = int(np.argmax(score(1)))
        assert best == f"c{chosen}" and omega == pytest.approx((sorted(score(0)).index(score(0)[chosen]) + 1) / 5)


@pytest.mark.parametrize("ties", [True, False])
def test_expanding_counts_of_a_long_series(spark, ties):
    rnd = random.Random(3)
    n = 100_000
    values = [None if rnd.random() < 0.05 else float(rnd.randint(0, 500)) if ties else rnd.random() for _ in range(n)]
    rows = [("a", i, v) for i, v in enumerate(values)] + [("b", 5, 1.0), ("c", 5, None), ("d", 1, 2.0), ("d", 9, 2.0)]
    got = windows.expanding_counts(spark.createDataFrame(rows, "k string, pos int, v double"), ["k"], "v").toPandas().sort_values(["k", "pos"])
    history, want = [], []
    for v in values:
        if v is not None:
            bisect.insort(history, v)
        want.append((len(history), 0 if v is None else bisect.bisect_left(history, v), 0 if v is None else bisect.bisect_right(history, v)))
    own = got[got.k == "a"]
    assert list(zip(own.hist_n, own.hist_lt, own.hist_le, strict=True)) == want
    rest = got[got.k != "a"]
    assert rest[["hist_n", "hist_lt", "hist_le"]].values.tolist() == [[1, 0, 1], [0, 0, 0], [1, 0, 1], [2, 0, 2]]


def test_large_cross_sections_take_the_bucket_way(spark):
    rng = np.random.default_rng(8)
    rows = [(DAY, f"s{i}", "f", float(round(x, 1))) for i, x in enumerate(rng.normal(size=300))]
    rows += [(DAY + dt.timedelta(1), f"s{i}", "f", float(i % 5)) for i in range(40)]
    panel = spark.createDataFrame(rows, "date date, symbol string, factor string, value double")
    returns = panel.select("date", "symbol", F.lit(1).alias("horizon"), (F.col("value") * F.rand(1) + F.rand(2)).alias("ret"))
    one = {(r.date, round(r.ic, 12), r.n) for r in labels.rank_ic(panel, returns, series=("factor", "horizon"), min_names=5).collect()}
    two = {(r.date, round(r.ic, 12), r.n) for r in labels.rank_ic(panel, returns, series=("factor", "horizon"), min_names=5, group_limit=100).collect()}
    assert one == two and len(one) == 2
    light, heavy = ranking.by_size(panel, ["date"], 100)
    assert light.count() == 40 and heavy.count() == 300 and ranking.by_size(panel, ["date"], 1000)[1] is None


def test_books_are_carried_from_date_to_date(spark):
    rnd = random.Random(11)
    names = [f"n{i}" for i in range(12)]
    days = [DAY + dt.timedelta(i) for i in range(30)]
    live = {d: {n for n in names if rnd.random() < 0.85} for d in days}
    target = {d: {n: rnd.choice([-1, 1]) * rnd.choice([0.02, 0.05, 0.055, 0.1]) for n in rnd.sample(sorted(live[d]), min(5, len(live[d])))} for d in days}
    opening, band, want, book = {"n0": 0.3, "gone": 0.2, "n1": 0.004}, 0.01, set(), {}
    book = dict(opening)
    for d in days:
        new = {}
        for n in {*book, *target[d]}:
            prev, wish = book.get(n, 0.0), target[d].get(n)
            if n not in live[d]:
                w, calm = 0.0, False
            else:
                calm = abs((wish or 0.0) - prev) < band
                w = prev if calm else wish or 0.0
            want.add((d, n, prev, w, n in live[d], calm))
            if w:
                new[n] = w
        book = new
    frames = (
        spark.createDataFrame([(d, n, w) for d in days for n, w in target[d].items()], "date date, symbol string, weight double"),
        spark.createDataFrame([(d, n) for d in days for n in live[d]], "date date, symbol string"),
        spark.createDataFrame(list(opening.items()), "symbol string, weight double"),
    )
    got = portfolio.carry_weights(frames[0], frames[1], band, frames[2])
    assert {(r.date, r.symbol, r.prev_weight, r.weight, r.candidate, r.banded) for r in got.collect()} == want
    assert portfolio.carry_weights(frames[0].limit(0), frames[1], band, frames[2]).count() == 0
    # Cut in two, the second part opens with the book of the first.
    half = days[14]
    first = portfolio.carry_weights(*[f.filter(F.col("date") <= half) for f in frames[:2]], band, frames[2])
    end = first.filter((F.col("date") == half) & (F.col("weight") != 0)).select("symbol", "weight")
    second = portfolio.carry_weights(*[f.filter(F.col("date") > half) for f in frames[:2]], band, end)
    assert sorted(map(tuple, first.unionByName(second).collect())) == sorted(map(tuple, got.collect()))


def test_largest_overlap_as_brute_force(spark):
    from tidemark.operators import formula

    rnd = random.Random(5)
    tokens = [f"t{i}" for i in range(60)]
    draw = lambda: sorted({tokens[int(60 * rnd.random() ** 2)] for _ in range(rnd.randint(1, 9))})
    mine, kept = [draw() for _ in range(2_000)] + [["only"], []], [draw() for _ in range(2_000)]
    frames = [spark.createDataFrame([(s,) for s in rows], "set array<string>").distinct() for rows in (mine, kept)]
    got = {tuple(r["set"]): r.overlap for r in formula.largest_overlap(*frames).collect()}
    others = [set(k) for k in {tuple(k) for k in kept}]
    want = {m: max(len(set(m) & k) / len(set(m) | k) for k in others) for m in {tuple(m) for m in mine}}
    assert got == pytest.approx({m: v for m, v in want.items() if v > 0})
    penalised = formula.novelty_penalty(spark.createDataFrame([(1, ["t1", "t1", "t2"]), (2, ["zz"]), (3, [])], "candidate int, tokens array<string>"),
                                        spark.createDataFrame([(["t2", "t1"],), (["t1"],)], "tokens array<string>")).collect()
    assert sorted((r.candidate, r.penalty) for r in penalised) == [(1, 0.2), (2, 0.0), (3, 0.0)]


@pytest.mark.parametrize("window", [1, 2, 9, 400])
def test_trailing_rank_as_brute_force(spark, window):
    rnd = random.Random(window)
    series = {k: {p: None if rnd.random() < 0.1 else float(rnd.randint(0, 30)) for p in range(300) if rnd.random() < 0.9} for k in "ab"}
    rows = [(k, p, v) for k, own in series.items() for p, v in own.items()]
    got = windows.with_trailing_rank(spark.createDataFrame(rows, "symbol string, pos int, v double"), "v", window, "rank").collect()
    assert len(got) == len(rows)
    for r in got:
        inside = [v for p, v in series[r.symbol].items() if r.pos - window < p <= r.pos and v is not None]
        ready = r.v is not None and len(inside) > 1 and r.pos >= window - 1
        assert r["rank"] == (pytest.approx(sum(v < r.v for v in inside) / (len(inside) - 1) - 0.5) if ready else None)


def test_short_trailing_ranks_multiply_no_row(spark):
    rnd = random.Random(3)
    rows = [(k, p, None if rnd.random() < 0.1 else float(rnd.randint(0, 9))) for k in "abc" for p in range(80) if rnd.random() < 0.8]
    df = spark.createDataFrame(rows, "symbol string, pos int, v double")
    lags = windows.with_trailing_rank(df, "v", 7, "rank")
    assert "Generate" not in lags._jdf.queryExecution().optimizedPlan().toString()
    merged = windows.with_trailing_rank(df, "v", 7, "rank", limit=0).select(*lags.columns)
    assert sorted(map(str, lags.collect())) == sorted(map(str, merged.collect()))


def test_undefined_scores_rank_as_in_the_sql(spark):
    # "a" wins every split it is measured in; without a loss its Sortino ratio is undefined on the other side.
    returns = {"a": [0.9, -0.001, 0.5, 0.4] * 2 + [0.5] * 8, "b": [0.1, -0.2] * 8, "c": [0.2, -0.3] * 8, "d": [0.3] * 8 + [0.2, -0.1] * 4}
    rows = [(c, i, r) for c, own in returns.items() for i, r in enumerate(own)]
    aligned = sharpe.right_align(spark.createDataFrame(rows, "strategy string, pos int, ret double"), "strategy", "ret")
    got = {r.mask: r for r in sharpe.split_logits(aligned, n_partitions=4, metric=paths.SORTINO).collect()}
    seen = set()
    for mask, r in got.items():
        def score(c, inside):
            xs = [x for i, x in enumerate(returns[c]) if ((mask >> (i // 4)) & 1 == 1) == inside]
            down = (sum(min(x, 0.0) ** 2 for x in xs) / len(xs)) ** 0.5
            return sum(xs) / len(xs) / down if down else None
        own, others = score(r.best, False), [score(c, False) for c in returns]
        below, equal = (sum(o is not None and own is not None and f(o, own) for o in others) for f in (lambda o, w: o < w, lambda o, w: o == w))
        assert r.omega == pytest.approx((below + (equal + 1) / 2) / 5)
        seen |= {own is None, any(o is None for o in others) and own is not None}
    assert len(got) == 6 and seen == {True, False}
