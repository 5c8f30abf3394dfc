"""Distributed ranks and quantiles against pandas, including heavy ties and hot groups."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import ranking as R


#: Rows that one task may order: all groups, none but the small ones, none.
LIMITS = (1_000_000, 1_500, 1)


@pytest.fixture(scope="module", params=["many buckets", "one bucket"])
def values(spark, request):
    rng = np.random.default_rng(3)
    n = 4000
    # one group holds most rows, and a third of it shares one value
    pdf = pd.DataFrame(
        {
            "g": np.where(rng.random(n) < 0.7, "hot", rng.choice(["a", "b"], n)),
            "symbol": [f"S{i:06d}" for i in rng.permutation(n)],
            "value": np.where(rng.random(n) < 0.33, 0.0, rng.normal(size=n) * 10.0 ** rng.integers(-8, 8, n)),
        }
    )
    if request.param == "one bucket":  # all values within one code of the bucket table
        pdf["value"] = 5.0 + rng.integers(0, 500, n) * 1e-7
        assert spark.createDataFrame(pdf).select(R.value_bucket(F.col("value"))).distinct().count() == 1
    return pdf, spark.createDataFrame(pdf)


def test_average_rank(values):
    pdf, df = values
    got = R.average_rank(df, ["g"], "value", "r").toPandas().set_index("symbol").r.sort_index()
    want = pdf.assign(r=pdf.groupby("g").value.rank()).set_index("symbol").r.sort_index()
    assert (got == want).all()


@pytest.mark.parametrize("limit", LIMITS)
def test_ordinal_rank_breaks_ties_by_symbol(values, limit):
    pdf, df = values
    ranked = R.ordinal_rank(
        df, ["g"], "value", "symbol", "r", n_out="n", tie_code=F.substring("symbol", 1, 4), limit=limit
    )
    got = ranked.toPandas().set_index("symbol").sort_index()
    ordered = pdf.sort_values(["g", "value", "symbol"])
    want = ordered.assign(r=ordered.groupby("g").cumcount() + 1).set_index("symbol").r.sort_index()
    assert (got.r == want).all()
    assert (got.n == got.groupby("g").r.transform("max")).all()


@pytest.mark.parametrize("limit", LIMITS)
def test_group_quantiles_match_linear_interpolation(values, limit):
    pdf, df = values
    got = R.group_quantiles(df, ["g"], "value", {"lo": 0.01, "mid": 0.5, "hi": 0.99}, limit=limit).toPandas().set_index("g").sort_index()
    want = pdf.groupby("g").value.quantile([0.01, 0.5, 0.99]).unstack().sort_index()
    np.testing.assert_allclose(got[["lo", "mid", "hi"]].values, want.values, rtol=1e-12)


@pytest.mark.parametrize("limit", LIMITS)
def test_tails_agree_with_full_sort(values, limit):
    pdf, df = values
    size = F.floor(F.col("group_n") / 5)
    got = R.select_tails(df, ["g"], "value", "symbol", size, tie_code=F.substring("symbol", 1, 4), limit=limit).toPandas()
    want = set()
    for _, part in pdf.sort_values(["value", "symbol"]).groupby("g"):
        k = len(part) // 5
        want |= {(s, -1) for s in part.symbol[:k]} | {(s, 1) for s in part.symbol[-k:]}
    assert set(zip(got.symbol, got.side)) == want


def test_bucket_code_preserves_order(spark):
    xs = sorted([-1e300, -3.5, -3.4999, -1e-300, 0.0, 5e-324, 1e-9, 0.1, 0.10001, 7.0, 1e308])
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    codes = [r.c for r in rows.select("i", R.value_bucket(F.col("x")).alias("c")).orderBy("i").collect()]
    assert codes == sorted(codes)


@pytest.mark.parametrize("limit", [1_000, 3])
def test_one_sided_tails_may_hold_the_whole_group(spark, limit):
    df = spark.createDataFrame([("g", f"s{i}", float(i % 4)) for i in range(9)], "g string, symbol string, value double")
    for n in (3, 9):
        got = R.select_tails(df, ["g"], "value", "symbol", F.least(F.lit(n), F.col("group_n")), sides=(1,), limit=limit).collect()
        want = sorted(((float(i % 4), f"s{i}") for i in range(9)), reverse=True)[:n]
        assert {(r.value, r.symbol) for r in got} == set(want) and {r.side for r in got} == {1} and {r.tail_n for r in got} == {n}
