"""Wide cross-sections against the long operators, with arrays and with value buckets."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.config import FactorConfig
from tidemark.operators import columnar, factors, formula, labels
from tidemark.operators.crosssection import tail_weights, treat
from tidemark.plans import q_signals, studies
from tidemark.plans.catalog import BOOK, Inputs
from tidemark.session import stage

#: Rows of a date that one task may hold: all dates, only the small one, none.
LIMITS = (1_000_000, 50, 1)


@pytest.fixture(scope="module")
def wide(spark):
    rng = np.random.default_rng(5)
    rows = []
    for day, n in (("2024-01-01", 300), ("2024-01-08", 40), ("2024-01-15", 3), ("2024-01-22", 80)):
        a = np.round(rng.normal(size=n), 1)  # ties
        b = np.full(n, 7.3) if day == "2024-01-22" else rng.normal(size=n) ** 3  # one constant cross-section
        y = np.round(a + rng.normal(size=n), 1)
        gap = lambda x, p: [None if u < p else float(v) for u, v in zip(rng.random(n), x)]
        rows += list(zip([day] * n, [f"S{i:05d}" for i in range(n)], gap(a, 0.1), gap(b, 0.4), gap(y, 0.2), [None] * n))
    frame = spark.createDataFrame(rows, "day string, symbol string, a double, b double, fwd_1 double, fwd_9 double")
    return frame.withColumn("date", F.to_date("day")).drop("day")


def _rows(df, columns, digits=10):
    pdf = df.select(*columns).toPandas().astype({"date": str})
    return pdf.sort_values(list(columns[:3])).reset_index(drop=True).round(digits)


@pytest.mark.parametrize("limit", LIMITS)
def test_treated_columns_equal_the_long_treatment(wide, limit):
    long = columnar.long_view(wide, {"a": "a", "b": "b"}, "factor", ["date", "symbol"])
    want = treat(long, winsor=(0.05, 0.9), by=("factor", "date"))
    held, names = columnar.treat_columns(stage(wide), ["a", "b"], winsor=(0.05, 0.9), limit=limit)
    got = columnar.treated_long(held, {c: (c, names[c]) for c in ("a", "b")}, "factor", ["date", "symbol"])
    columns = ["factor", "date", "symbol", "value"]
    pd.testing.assert_frame_equal(_rows(got, columns), _rows(want, columns))


@pytest.mark.parametrize("limit", LIMITS)
def test_rank_ic_of_columns_equals_the_long_one(wide, limit):
    panel = columnar.long_view(wide, {"a": "a", "b": "b"}, "factor", ["date", "symbol"])
    want = labels.rank_ic(panel, labels.horizon_long(wide, [1, 9]), series=("factor", "horizon"), min_names=4)
    got = columnar.rank_ic_columns(stage(wide), {"a": "a", "b": "b"}, {1: "fwd_1", 9: "fwd_9"}, min_names=4, limit=limit)
    columns = ["factor", "date", "horizon", "ic", "n"]
    assert got.filter("ic IS NULL").count() == 1  # the constant cross-section counts its names
    pd.testing.assert_frame_equal(_rows(got, columns), _rows(want, columns), check_dtype=False)


def test_study_stages_only_the_prices_it_reads(spark):
    """What factors, labels and backtests do not read is neither aggregated from the lines nor written."""
    study = Inputs(spark, "/root/testdata/sf0.001").study
    assert set(study.prices.columns) == {"date", "symbol", "adj_close", "close", "volume", "turnover", "delivery_pct"}


def test_study_moves_one_row_per_name_and_session(spark):
    """Neither factors nor horizons multiply the rows that the ICs of a study shuffle."""
    t = Inputs(spark, "/root/testdata/sf0.001")
    study = t.study
    plan = studies.ic_series(study, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Generate" not in plan and "SortMergeJoin" not in plan
    long = labels.rank_ic(study.panel, study.labels, series=("factor", "horizon"), min_names=5)
    columns = ["factor", "date", "horizon", "ic", "n"]
    pd.testing.assert_frame_equal(_rows(studies.ic_series(study, 5), columns), _rows(long, columns), check_dtype=False)


@pytest.mark.parametrize("limit", LIMITS)
@pytest.mark.parametrize("long_only", (False, True))
def test_tails_of_columns_equal_the_long_ones(wide, limit, long_only):
    """Ties, a constant column, gaps, and a date with fewer names than quantiles."""
    placed = stage(wide.withColumn("pos", F.datediff("date", F.lit("2024-01-01")).cast("int")))
    columns = {"a": "a", "b": "b", "none": "fwd_9"}
    long = columnar.long_view(placed, columns, "strategy", ["date", "pos", "symbol"])
    want = tail_weights(long, by=["strategy", "date", "pos"], n_quantiles=4, leverage=0.3, long_only=long_only)
    got = columnar.tail_columns(placed, columns, n_quantiles=4, leverage=0.3, long_only=long_only, limit=limit)
    columns = ["strategy", "symbol", "date", "weight"]
    assert want.count() > 50
    got, want = (_rows(x.withColumnRenamed("date", "_day").withColumnRenamed("pos", "date"), columns) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_conditional_targets_move_one_row_per_name_and_session(spark, monkeypatch):
    """Strategies of a conditional study are columns up to their tails, with the rows the long selection gives."""
    t = Inputs(spark, "/root/testdata/sf0.001")
    days = [r.date for r in t.study.wide.select("date").distinct().orderBy("date").collect()]
    pairs = [(f, f"{f}|x", d) for f in t.study.names[:2] for d in days[::3]]
    inside = spark.createDataFrame([p[1:] for p in pairs], "strategy string, date date").withColumn("_on", F.lit(True))
    named = spark.createDataFrame(sorted({p[:2] for p in pairs}), "factor string, strategy string")
    got = studies._conditional_targets(t.study, named, inside, BOOK, None)
    plan = got._jdf.queryExecution().executedPlan().toString()
    # By date go the names, once, and the short table of dates inside.
    assert plan.count("Exchange hashpartitioning") == 2 and "Generate" not in plan and "hashpartitioning(strategy" not in plan
    monkeypatch.setattr(t.study, "wide", None)
    want = studies._conditional_targets(t.study, named, inside, BOOK, None)
    columns = ["strategy", "symbol", "date", "weight"]
    assert want.select("strategy").distinct().count() == 4
    got, want = (_rows(x.withColumnRenamed("pos", "date"), columns) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_wide_labels_are_the_forward_returns(spark):
    t = Inputs(spark, "/root/testdata/sf0.001")
    cfg = FactorConfig(10, 2, (3, 5), 8, 5, 5, 5)
    wide = factors.factor_wide(t.px, t.sessions, factors.default_library(cfg), [1, 4])
    got, want = (labels.horizon_long(x, [1, 4]) for x in (wide, labels.forward_returns(t.px, t.sessions, [1, 4])))
    assert want.count() > 0 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


@pytest.mark.parametrize("limit", LIMITS)
def test_formulas_in_turns_equal_those_in_long_form(spark, limit):
    """Cross-sections inside and outside windows, ties, gaps and a name alone on its date; sums of quarters are exact."""
    rng = np.random.default_rng(9)
    rows = [
        (f"S{i:03d}", p, *[None if rng.random() < 0.1 else float(np.round(4 * rng.normal()) / 4) for _ in range(4)], 1.0, -0.5, 0.0, 2.0, 1.0)
        for i in range(60) for p in range(12) if (p != 11 or i == 0) and (i < 40 or p > 4)
    ]
    names = formula.PRICE_TERMINALS + formula.FLOW_TERMINALS
    base = spark.createDataFrame(rows, "symbol string, pos int, " + ", ".join(f"{n} double" for n in names))
    batch = [("close", "rank"), ("volume", "rank", "mean5"), ("close", "mean5", "zscore", "rank", "returns", "mul"), ("close",), ("returns", "neg")]
    pdf = base.toPandas().sort_values(["symbol", "pos"])

    def rank(x):
        ordered = pdf.assign(x=x).dropna(subset="x").sort_values(["pos", "x", "symbol"])
        place, n = ordered.groupby("pos").cumcount(), ordered.groupby("pos").x.transform("size")
        return (place / (n - 1).where(n > 1) - 0.5).reindex(pdf.index)

    def mean5(x):
        grid = pdf.assign(x=x).pivot(index="pos", columns="symbol", values="x").rolling(5, min_periods=3).mean()
        at = pd.MultiIndex.from_frame(pdf[["pos", "symbol"]])
        return pd.Series(grid.stack().reindex(at).to_numpy(), pdf.index).where(pdf.pos >= 4)

    smooth = mean5(pdf.close)
    by = smooth.groupby(pdf.pos)
    z = (smooth - by.transform("mean")) / by.transform("std", ddof=0).where(by.transform("std", ddof=0) > 1e-12)
    want = [rank(pdf.close), mean5(rank(pdf.volume)), rank(z) * pdf.returns, pdf.close, -pdf.returns]
    got = formula.evaluate(base, batch, limit=limit).toPandas()
    for i, w in enumerate(want):
        mine = got[got.candidate == i].set_index(["symbol", "pos"]).value
        w = w.set_axis(pd.MultiIndex.from_frame(pdf[["symbol", "pos"]])).dropna()
        assert len(mine) == len(w)
        np.testing.assert_allclose(mine.reindex(w.index), w, atol=1e-12)


def test_formulas_shuffle_only_what_later_turns_read(spark):
    """One shuffle by date per turn, no row per sub-expression."""
    base = spark.createDataFrame([("A", 0, *[1.0] * 9)], "symbol string, pos int, " + ", ".join(f"{n} double" for n in formula.PRICE_TERMINALS + formula.FLOW_TERMINALS))
    parts = formula.evaluate_columns(base, [("close", "rank"), ("volume", "zscore"), ("returns", "neg")])
    assert [sorted(c) for _, c in parts] == [[2], [0, 1]]
    plan = parts[-1][0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "turnover" not in plan.split("InMemoryRelation")[0]


def test_selection_reads_a_staged_signal(spark, monkeypatch):
    """Counts per date and the selection itself read the signal; it is composed once."""
    purposes = []
    monkeypatch.setattr(q_signals, "stage", lambda df, purpose="stage": purposes.append(purpose) or stage(df, purpose))
    assert q_signals._selected(Inputs(spark, "/root/testdata/sf0.001")).count() > 0
    assert "signal" in purposes
