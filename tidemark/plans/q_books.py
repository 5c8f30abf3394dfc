"""Registered queries: backtests, costs, equity statistics and risk overlays."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..config import DrawdownControl, VolTarget
from ..functions.ranking import group_quantiles
from ..operators import backtest as B
from ..operators import costs, risk, windows
from ..session import stage
from . import oracle, studies
from .catalog import BOOK, COSTS, Inputs, query

DAILY = "gross_return:9 turnover:9 n_long:i n_short:i"


@query("b1_target_weights", "strategy symbol pos:i weight:9", "SELECT * FROM tails WHERE weight <> 0")
def _(t: Inputs):
    return t.targets


@query(
    "b2_sleeves",
    "strategy symbol pos:i book:9 delta:9",
    "SELECT * FROM bk WHERE pos < (SELECT p FROM lastpos) AND (abs(book) > 1e-12 OR abs(delta) > 1e-12)",
)
def _(t: Inputs):
    rows = B.sleeve_positions(t.targets, t.sessions, BOOK.holding)
    return rows.filter((F.abs("book") > 1e-12) | (F.abs("delta") > 1e-12))


@query(
    "b3_daily_returns",
    f"strategy pos:i date:d {DAILY} unpriced_days:i unpriced_gross:9",
    "dly",
)
def _(t: Inputs):
    return t.daily


@query("b4_fixed_cost", "strategy pos:i buys:9 sells:9 fixed_cost:14", "dly")
def _(t: Inputs):
    return t.daily


@query(
    "b5_impact_cost",
    "strategy pos:i impact_unit:12 missing_adv:i cost:9 net_return:9",
    "dlyn",
)
def _(t: Inputs):
    return t.daily


@query(
    "b6_trade_costs",
    "pos:i buy_value:4 sell_value:4 fixed:6 impact:5 total:5 n_missing_adv:i bps:6",
    """SELECT *, fixed + impact AS total, 1e4 * (fixed + impact) / 1e5 AS bps FROM (
       SELECT b.pos, sum(greatest(delta, 0)) * 1e5 AS buy_value, sum(greatest(-delta, 0)) * 1e5 AS sell_value,
         1e5 * (0.00045::DOUBLE * sum(greatest(delta, 0)) + 0.0013::DOUBLE * sum(greatest(-delta, 0))) AS fixed,
         sum(CASE WHEN adv > 0 THEN abs(delta * 1e5) * 0.1::DOUBLE * sqrt(abs(delta * 1e5) / adv) ELSE 0 END) AS impact,
         count(*) FILTER (abs(delta) > 0 AND coalesce(adv, 0) <= 0) AS n_missing_adv
       FROM bk b LEFT JOIN mkt m ON m.symbol = b.symbol AND m.pos = b.pos WHERE b.pos < (SELECT p FROM lastpos) GROUP BY 1)""",
)
def _(t: Inputs):
    moves = B.sleeve_positions(t.targets, t.sessions, BOOK.holding)
    market = B.market_steps(t.px, t.sessions, COSTS.adv_window).select("symbol", "pos", "adv")
    trades = moves.join(market, ["symbol", "pos"], "left").withColumn("trade_value", F.col("delta") * F.lit(BOOK.notional))
    return costs.trade_costs(trades, COSTS, ("pos",), notional=BOOK.notional)


@query(
    "b7_break_even",
    "strategy median_adv:4 break_even_aum:0",
    """SELECT strategy, adv AS median_adv, CASE WHEN annual_turnover <= 0 OR adv <= 0 THEN 'Infinity'::DOUBLE
         WHEN gross_annual_return - 0.000875::DOUBLE * annual_turnover <= 0 THEN 0
         ELSE pow((gross_annual_return - 0.000875::DOUBLE * annual_turnover) / (0.1::DOUBLE * annual_turnover), 2) * adv / 0.05::DOUBLE END AS break_even_aum
       FROM bsum CROSS JOIN (SELECT quantile_cont(adv, 0.5::DOUBLE) AS adv FROM mkt WHERE adv IS NOT NULL)""",
)
def _(t: Inputs):


    adv = windows.average_daily_value(t.px, COSTS.adv_window).withColumn("all", F.lit(1))
    # one group holds every row: the bucketed quantile never collects it in one task
    median = group_quantiles(stage(adv, "adv"), ["all"], "adv", {"m": 0.5}, max_groups=1).select("m")
    summary = B.summarize_backtest(t.daily, ["strategy"]).withColumn("median_adv", median.scalar())
    aum = costs.break_even_aum(
        F.col("gross_annual_return"), F.col("annual_turnover"), F.col("median_adv"), COSTS, BOOK.leverage
    )
    return summary.withColumn("break_even_aum", aum)


SUMMARY = (
    "n_days:i gross_sharpe:7 net_sharpe:7 gross_annual_return:8 net_annual_return:8 annual_turnover:7 total_cost_bps:6 "
    "max_drawdown:8 time_under_water:i calmar:6 trades_without_adv:i unpriced_position_days:i unpriced_gross_exposure:7"
)


@query("b8_backtest_summary", f"strategy {SUMMARY}", "bsum")
def _(t: Inputs):
    return B.summarize_backtest(t.daily, ["strategy"])


oracle.part("two", f"{oracle.sized('dly', '1e5')} UNION ALL {oracle.sized('dly', '1.0')}")
oracle.part("twosum", oracle.summary("two", "strategy, notional"))


@query("b9_two_scales", f"strategy notional:0 {SUMMARY}", "twosum")
def _(t: Inputs):
    daily = studies.evaluate_factors(t.study, BOOK, [BOOK.notional, 1.0])
    return B.summarize_backtest(stage(daily, "daily"), ["strategy", "notional"])


# -- equity curves -----------------------------------------------------------------------

oracle.part("ddn", oracle.drawdowns("dlyn", "strategy", "net_return"))


@query("r16_equity_curve", "strategy pos:i equity:4", "ddn")
def _(t: Inputs):
    return windows.with_drawdown(t.daily, ["strategy"], "net_return")


@query("r17_max_drawdown", "strategy max_drawdown:9", "SELECT strategy, min(drawdown) AS max_drawdown FROM ddn GROUP BY 1")
def _(t: Inputs):
    return windows.drawdown_summary(t.daily, ["strategy"], "net_return")


@query("r18_time_under_water", "strategy time_under_water:i", "SELECT strategy, max(under_run) AS time_under_water FROM ddn GROUP BY 1")
def _(t: Inputs):
    return windows.drawdown_summary(t.daily, ["strategy"], "net_return")


# -- overlays ----------------------------------------------------------------------------

RELATIVE = VolTarget(True, "relative", 0.10, window=12, long_window=52, min_obs=12)
ABSOLUTE = VolTarget(True, "absolute", 0.10, window=12, long_window=52, min_obs=12)


def _sd(window: int) -> str:
    w = f"(PARTITION BY strategy ORDER BY pos ROWS BETWEEN {window} PRECEDING AND 1 PRECEDING)"
    sd = f"stddev_samp(unit_return) OVER {w}"
    return f"CASE WHEN {sd} > 1e-12 * greatest(max(abs(unit_return)) OVER {w}, 1e-300) THEN {sd} END"


def _vol_sql(aim: str, needed: int, upper: str) -> str:
    return f"""
    SELECT strategy, pos, CASE WHEN ok THEN greatest(least(aim / vol, {upper}), 0.25::DOUBLE) ELSE 1.0 END AS scale,
      CASE WHEN seen >= {needed} THEN vol END AS realized_vol,
      last_value(CASE WHEN ok THEN aim END IGNORE NULLS) OVER (PARTITION BY strategy ORDER BY pos ROWS UNBOUNDED PRECEDING) AS target_vol
    FROM (SELECT *, seen >= {needed} AND vol IS NOT NULL AND aim IS NOT NULL AS ok FROM (
      SELECT strategy, pos, {_sd(12)} AS vol, {aim} AS aim,
        count(unit_return) OVER (PARTITION BY strategy ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM dly))
    """


oracle.part("vrel", _vol_sql(_sd(52), 52, "2.0::DOUBLE"))
oracle.part("vabs", _vol_sql("0.10::DOUBLE / sqrt(252)", 12, "2.0::DOUBLE"))
oracle.part("vdel", _vol_sql(_sd(52), 52, "1.0::DOUBLE"))


@query(
    "b10_volatility_target",
    "mode strategy pos:i scale:7 realized_vol:9 target_vol:9",
    "SELECT 'relative' AS mode, * FROM vrel UNION ALL SELECT 'absolute', * FROM vabs",
)
def _(t: Inputs):
    plain = t.daily.select("strategy", "pos", "unit_return")
    both = [
        risk.volatility_scale(plain, cfg).withColumn("mode", F.lit(cfg.mode)) for cfg in (RELATIVE, ABSOLUTE)
    ]
    return both[0].unionByName(both[1])


# The fold as a recursion over sessions: what each sleeve age returns and what each pair of scales costs.
_DELTA = "w0 * {a} - w4 * {b}"
_COST = (
    "sum(0.00045::DOUBLE * greatest({d}, 0) + 0.0013::DOUBLE * greatest(-({d}), 0) + "
    "CASE WHEN abs({d}) > 0 AND adv > 0 THEN abs({d}) * 0.1::DOUBLE * sqrt(1e5::DOUBLE) * sqrt(abs({d}) / adv) ELSE 0 END)"
)
oracle.part("ddin", f"""
WITH d AS (SELECT n.strategy, n.symbol, s.pos, coalesce(t.weight, 0) / 4 AS w0
    FROM (SELECT DISTINCT strategy, symbol FROM tails WHERE weight <> 0) n CROSS JOIN sessions s
    LEFT JOIN tails t ON t.strategy = n.strategy AND t.symbol = n.symbol AND t.pos = s.pos),
  a AS (SELECT *, {", ".join(f"coalesce(lag(w0, {k}) OVER (PARTITION BY strategy, symbol ORDER BY pos), 0) AS w{k}" for k in range(1, 5))} FROM d)
SELECT a.strategy, a.pos, {", ".join(f"sum(w{k} * coalesce(step, 0)) AS p{k}" for k in range(4))},
  {", ".join(f"{_COST.format(d=_DELTA.format(a=x, b=y))} AS c{i}{j}" for i, x in enumerate((1.0, 0.5)) for j, y in enumerate((1.0, 0.5)))}
FROM a LEFT JOIN mkt m ON m.symbol = a.symbol AND m.pos = a.pos WHERE a.pos < (SELECT p FROM lastpos) GROUP BY 1, 2
""")
oracle.part("ddst", """
SELECT * FROM (WITH RECURSIVE f AS (
  SELECT strategy, min(pos) - 1 AS pos, [1.0, 1.0, 1.0, 1.0]::DOUBLE[] AS used, 1.0::DOUBLE AS equity, 1.0::DOUBLE AS peak, 0.0::DOUBLE AS dd,
    false AS low, 1.0::DOUBLE AS scale, 0.0::DOUBLE AS drawdown, false AS derisked FROM ddin GROUP BY 1
  UNION ALL
  SELECT strategy, pos, used, equity, peak, equity / peak - 1, CASE WHEN was THEN equity / peak - 1 < -0.02::DOUBLE ELSE equity / peak - 1 <= -0.05::DOUBLE END, now, before, was
  FROM (SELECT strategy, pos, [now, used[1], used[2], used[3]] AS used, equity * (1 + net) AS equity, greatest(peak, equity * (1 + net)) AS peak, low AS was, now, dd AS before
    FROM (SELECT *, p0 * now + p1 * used[1] + p2 * used[2] + p3 * used[3]
        - CASE WHEN now = 1 AND used[4] = 1 THEN c00 WHEN now = 1 THEN c01 WHEN used[4] = 1 THEN c10 ELSE c11 END AS net
      FROM (SELECT d.*, f.used, f.equity, f.peak, f.dd, f.low, CASE WHEN f.low THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS now
        FROM f JOIN ddin d ON d.strategy = f.strategy AND d.pos = f.pos + 1))))
SELECT strategy, pos, scale, drawdown, derisked FROM f WHERE pos >= (SELECT min(pos) FROM ddin))
""")
oracle.part("tdd", "SELECT t.strategy, t.symbol, t.pos, t.weight, v.scale FROM tails t JOIN ddst v ON v.strategy = t.strategy AND v.pos = t.pos")
oracle.part("bkdd", oracle.book("tdd", "strategy"))
oracle.part("dlydd", oracle.daily("bkdd", "strategy"))


@query(
    "b11_drawdown_control",
    "strategy pos:i gross_return:9 scale:6 drawdown:8 derisked",
    "SELECT d.strategy, d.pos, d.gross_return, v.scale, v.drawdown, v.derisked FROM dlydd d JOIN ddst v ON v.strategy = d.strategy AND v.pos = d.pos",
)
def _(t: Inputs):
    control = DrawdownControl(True, 0.05, 0.5, 0.02)
    return studies.overlay_run(
        t.targets, t.study.prices, t.sessions, BOOK, VolTarget(), control, len(t.library)
    )


oracle.part("tvrel", "SELECT t.strategy, t.symbol, t.pos, t.weight, v.scale FROM tails t JOIN vrel v ON v.strategy = t.strategy AND v.pos = t.pos")
oracle.part("bkrel", oracle.book("tvrel", "strategy"))
oracle.part("dlyrel", oracle.daily("bkrel", "strategy"))


@query(
    "b12_overlay_summary",
    "strategy n_sessions:i mean_scale:7 min_scale:7 max_scale:7 fraction_levered:7 turnover:7 gross:7",
    """SELECT d.strategy, count(*) AS n_sessions, avg(scale) AS mean_scale, min(scale) AS min_scale, max(scale) AS max_scale,
         avg((scale > 1.000000000001::DOUBLE)::INT::DOUBLE) AS fraction_levered, sum(d.turnover) AS turnover, sum(d.gross_return) AS gross
       FROM dlyrel d JOIN vrel v ON v.strategy = d.strategy AND v.pos = d.pos GROUP BY 1""",
)
def _(t: Inputs):
    daily = stage(
        studies.overlay_run(
            t.targets, t.study.prices, t.sessions, BOOK, RELATIVE, DrawdownControl(), len(t.library)
        ),
        "daily",
    )
    totals = daily.groupBy("strategy").agg(F.sum("turnover").alias("turnover"), F.sum("gross_return").alias("gross"))
    return risk.overlay_summary(daily, ["strategy"]).join(totals, "strategy")


oracle.part("tvar", """
SELECT 'none' AS variant, *, 1.0::DOUBLE AS scale FROM tails
UNION ALL SELECT 'vol_absolute', t.*, v.scale FROM tails t JOIN vabs v ON v.strategy = t.strategy AND v.pos = t.pos
UNION ALL SELECT 'vol_relative', t.*, v.scale FROM tails t JOIN vrel v ON v.strategy = t.strategy AND v.pos = t.pos
UNION ALL SELECT 'vol_delever', t.*, v.scale FROM tails t JOIN vdel v ON v.strategy = t.strategy AND v.pos = t.pos
""")
oracle.part("bkvar", oracle.book("tvar", "variant, strategy"))
oracle.part("dlyvar", oracle.daily("bkvar", "variant, strategy"))
oracle.part("dlyvarn", oracle.sized("dlyvar", "1e5"))
oracle.part("sumvar", oracle.summary("dlyvarn", "variant, strategy"))


def _variants():
    every = studies.overlay_variants(12, 52, 0.10)
    return {k: v for k, v in every.items() if not v[1].enabled}


@query("b13_overlay_grid", f"variant strategy {SUMMARY}", "sumvar")
def _(t: Inputs):
    return studies.overlay_grid(t.targets, t.study.prices, t.sessions, BOOK, _variants(), len(t.library))


@query(
    "b13_overlay_comparison",
    "variant n_strategies:i improved_sharpe:i reduced_drawdown:i min_turnover_ratio:6 max_turnover_ratio:6",
    """SELECT a.variant, count(*) AS n_strategies, count(*) FILTER (a.net_sharpe > b.net_sharpe + 1e-9) AS improved_sharpe,
         count(*) FILTER (a.max_drawdown > b.max_drawdown + 1e-9) AS reduced_drawdown,
         min(a.annual_turnover / b.annual_turnover) AS min_turnover_ratio, max(a.annual_turnover / b.annual_turnover) AS max_turnover_ratio
       FROM sumvar a JOIN sumvar b ON b.strategy = a.strategy AND b.variant = 'none' WHERE a.variant <> 'none' GROUP BY 1""",
)
def _(t: Inputs):
    summary = studies.overlay_grid(t.targets, t.study.prices, t.sessions, BOOK, _variants(), len(t.library))
    return risk.compare_variants(stage(summary, "summary"))


@query("b13_all_variants", f"variant strategy {SUMMARY}")
def _(t: Inputs):
    every = studies.overlay_variants(12, 52, 0.10)
    control = DrawdownControl(True, 0.05, 0.5, 0.02)
    wired = {k: (v, replace(control, enabled=d.enabled)) for k, (v, d) in every.items()}
    return studies.overlay_grid(t.targets, t.study.prices, t.sessions, BOOK, wired, len(t.library))
