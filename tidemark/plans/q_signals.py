"""Registered queries: composite signal, gates, portfolio construction, data quality."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..operators import backtest as B
from ..operators import composite as S
from ..operators import panel, portfolio, quality, regimes, windows
from ..operators.factors import default_library
from ..session import scratch_dir, stage
from ..sources import tables
from ..streaming import incremental
from ..streaming.desk import DailyDesk
from . import oracle, studies
from .catalog import BOOK, COMPOSITE, CONSTRUCTION, COSTS, FACTORS, MIN_NAMES, REGIME, Inputs, query
from .q_inference import trial_count

# -- weights and composite ---------------------------------------------------------------

oracle.part("wspine", """
SELECT f.factor, s.pos, s.date, i.ic FROM (SELECT DISTINCT factor FROM ic4) f CROSS JOIN sessions s
LEFT JOIN ic4 i ON i.factor = f.factor AND i.date = s.date
""")
oracle.part("wscore", """
SELECT * FROM (SELECT factor, pos, date, count(ic) OVER w AS n, avg(ic) OVER w AS m,
  CASE WHEN stddev_samp(ic) OVER w > 0 THEN avg(ic) OVER w / stddev_samp(ic) OVER w ELSE 0 END AS ir FROM wspine
WINDOW w AS (PARTITION BY factor ORDER BY pos ROWS BETWEEN 51 PRECEDING AND 4 PRECEDING)) WHERE n >= 2
""")


def _weights(score: str, where: str = "true") -> str:
    return f"SELECT date, factor, score / sum(abs(score)) OVER (PARTITION BY date) AS weight FROM (SELECT *, {score} AS score FROM wscore WHERE {where})"


oracle.part("wts", _weights("ir", "ir > 0"))


@query(
    "s1_trailing_weights",
    "scheme date factor weight:8",
    f"SELECT 'ic_ir' AS scheme, * FROM wts UNION ALL SELECT 'ic_mean', * FROM ({_weights('m', 'm > 0')}) UNION ALL SELECT 'equal', * FROM ({_weights('1.0::DOUBLE')})",
)
def _(t: Inputs):
    out = None
    for scheme in ("ic_ir", "ic_mean", "equal"):
        part = S.trailing_weights(t.ic4, t.sessions, replace(COMPOSITE, scheme=scheme)).withColumn("scheme", F.lit(scheme))
        out = part if out is None else out.unionByName(part)
    return out


oracle.part("mix", """
SELECT date, symbol, sum(value * weight) / sum(abs(weight)) AS value FROM panel JOIN wts USING (date, factor)
WHERE value IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3
""")
oracle.part("comp", """
SELECT date, symbol, CASE WHEN count(*) OVER d >= 2 AND stddev_samp(value) OVER d > 1e-12 * max(abs(value)) OVER d
  THEN (value - avg(value) OVER d) / stddev_samp(value) OVER d END AS value FROM mix WINDOW d AS (PARTITION BY date)
""")


def _weights_frame(t: Inputs):
    return S.trailing_weights(t.ic4, t.sessions, COMPOSITE)


def _composite(t: Inputs):
    return S.composite(t.study.panel, _weights_frame(t), COMPOSITE, len(t.library))


@query("s2_composite", "date symbol value:6", "comp")
def _(t: Inputs):
    return _composite(t)


_FACTOR_NAMES = [f.name for f in default_library(FACTORS)]


@query(
    "t7_weight_history",
    "date " + " ".join(f"{f}:8" for f in _FACTOR_NAMES),
    "SELECT date, " + ", ".join(f"coalesce(max(weight) FILTER (factor = '{f}'), 0) AS {f}" for f in _FACTOR_NAMES) + " FROM wts GROUP BY 1",
)
def _(t: Inputs):
    return panel.weight_history(_weights_frame(t), [f.name for f in t.library])


# -- gates -------------------------------------------------------------------------------


@query("s3_gate_map", "factor regime_column", "SELECT factor, regime_column FROM fmap")
def _(t: Inputs):
    return regimes.expand_map(t.ic4.select("factor").distinct(), REGIME.factor_map)


oracle.part("gsample", """
SELECT m.factor, m.regime_column, s.pos AS today, s.date, b.regime AS bucket, c.pos, i.ic FROM fmap m CROSS JOIN sessions s
LEFT JOIN lbl b ON b.date = s.date AND b.regime_column = m.regime_column
LEFT JOIN (SELECT l.regime_column, l.regime, x.pos, x.date FROM lbl l JOIN sessions x ON x.date = l.date) c
  ON c.regime_column = m.regime_column AND c.regime = b.regime AND c.pos BETWEEN s.pos - 51 AND s.pos - 4
LEFT JOIN ic4 i ON i.factor = m.factor AND i.date = c.date
""")
oracle.part("gsamp2", "SELECT factor || '|' || today AS k, pos, ic FROM gsample")
oracle.part("gnw", oracle.newey_west("gsamp2", "k", "ic", "pos", "3"))
oracle.part("gates", """
SELECT *, coalesce(t_stat >= 1.5, false) AS "on" FROM (
SELECT g.date, g.factor, g.regime_column, g.bucket, CASE WHEN w.n >= 20 AND w.se > 0 THEN w.mean / w.se END AS t_stat, coalesce(w.n, 0) AS n_obs
FROM (SELECT DISTINCT date, factor, regime_column, bucket, today FROM gsample) g LEFT JOIN gnw w ON w.k = g.factor || '|' || g.today
WHERE g.factor IN (SELECT i.factor FROM ic4 i JOIN fmap m ON m.factor = i.factor JOIN lbl b ON b.date = i.date AND b.regime_column = m.regime_column
                   WHERE i.ic IS NOT NULL AND b.regime IS NOT NULL))
""")


def _gates(t: Inputs):
    return S.regime_gates(t.ic4, t.labels, t.sessions, COMPOSITE, REGIME)


@query("s4_regime_gates", "date factor regime_column bucket t_stat:6 n_obs:i on", "gates")
def _(t: Inputs):
    return _gates(t)


@query(
    "s5_gated_panel",
    "factor date symbol value:6",
    """SELECT p.factor, p.date, symbol, CASE WHEN g."on" = false THEN 0 ELSE value END AS value FROM panel p
       LEFT JOIN gates g ON g.date = p.date AND g.factor = p.factor""",
)
def _(t: Inputs):
    return S.gated_panel(t.study.panel, _gates(t), len(t.library))


@query("s5_on_fraction", "factor on_fraction:9", 'SELECT factor, avg("on"::INT::DOUBLE) AS on_fraction FROM gates GROUP BY 1')
def _(t: Inputs):
    return S.on_fraction(_gates(t))


# -- portfolio ---------------------------------------------------------------------------
# Decisions on every session from the composite of gated factors; each starts from the book before it.

oracle.part("gic", 'SELECT i.* FROM ic4 i LEFT JOIN gates g ON g.factor = i.factor AND g.date = i.date WHERE coalesce(g."on", true)')
oracle.part("gwspine", "SELECT s.factor, s.pos, s.date, i.ic FROM wspine s LEFT JOIN gic i ON i.factor = s.factor AND i.date = s.date")
oracle.part("gwscore", oracle.PARTS["wscore"].replace("wspine", "gwspine"))
oracle.part("gwts", _weights("ir", "ir > 0").replace("wscore", "gwscore"))
oracle.part("gpanel", """
SELECT p.date, symbol, p.factor, CASE WHEN g."on" = false THEN 0 ELSE value END AS value FROM panel p
LEFT JOIN gates g ON g.date = p.date AND g.factor = p.factor
""")
oracle.part("gmix", oracle.PARTS["mix"].replace("panel", "gpanel").replace("wts", "gwts"))
oracle.part("gcomp", oracle.PARTS["comp"].replace("FROM mix", "FROM gmix"))
oracle.part("sig", "SELECT date, pos, symbol, value FROM gcomp JOIN sessions USING (date) WHERE value IS NOT NULL")
oracle.part("sel", """
SELECT date, pos, symbol, CASE WHEN rn > n - k THEN 0.5 / k ELSE -0.5 / k END AS base, k, n AS n_candidates FROM (
SELECT *, least(10, n // 2)::DOUBLE AS k FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY value, symbol) AS rn,
  count(*) OVER (PARTITION BY date) AS n FROM sig)) WHERE rn <= k OR rn > n - k
""")
oracle.part("advd", "SELECT s.date, m.symbol, m.adv FROM mkt m JOIN sessions s USING (pos)")
oracle.part("caps", """
SELECT x.*, a.adv, least(0.08::DOUBLE, CASE WHEN a.adv > 0 THEN 0.1::DOUBLE * a.adv / 196613.0::DOUBLE END) AS cap,
  coalesce(0.1::DOUBLE * a.adv / 196613.0::DOUBLE < 0.08::DOUBLE, false) AS adv_bound, sign(base)::INT AS leg, abs(base) AS mag, coalesce(sector, 'NA') AS sector
FROM sel x LEFT JOIN advd a ON a.date = x.date AND a.symbol = x.symbol LEFT JOIN sectors c ON c.symbol = x.symbol
""")


def fill(source: str, group: str, mag: str, cap: str, target: str, out: str) -> str:
    """Water-filling as the level solving sum(min(mag * level, cap)) = target, by trying every breakpoint."""
    on = " AND ".join(f"a.{g.strip()} = b.{g.strip()}" for g in group.split(","))
    ag = ", ".join(f"a.{g.strip()}" for g in group.split(","))
    return f"""
    WITH lv AS (SELECT DISTINCT {group}, {cap} / {mag} AS lvl, {target} AS target FROM {source}),
    cand AS (SELECT {ag}, a.lvl, a.target, sum(CASE WHEN b.{cap} / b.{mag} < a.lvl THEN b.{cap} ELSE 0 END) AS fixed,
        sum(CASE WHEN b.{cap} / b.{mag} < a.lvl THEN 0 ELSE b.{mag} END) AS free
      FROM lv a JOIN {source} b ON {on} GROUP BY {ag}, a.lvl, a.target),
    lev AS (SELECT {group}, arg_min((target - fixed) / free, lvl) FILTER ((target - fixed) / free <= lvl) AS level FROM cand GROUP BY {group})
    SELECT a.*, greatest(0, CASE WHEN b.level IS NULL THEN a.{cap} ELSE least(a.{mag} * b.level, a.{cap}) END) AS {out}
    FROM {source} a JOIN lev b ON {on}
    """


oracle.part("secs", """
SELECT *, least(s_sum, CASE WHEN count(*) OVER (PARTITION BY date, leg) > 1 THEN 0.125::DOUBLE END) AS s_cap, 0.5::DOUBLE AS s_target
FROM (SELECT date, leg, sector, sum(mag) AS s_mag, sum(cap) AS s_sum FROM caps GROUP BY 1, 2, 3)
""")
oracle.part("secf", fill("secs", "date, leg", "s_mag", "s_cap", "s_target", "allot"))
oracle.part("parts0", "SELECT c.*, f.allot, f.capacity FROM caps c JOIN (SELECT *, sum(s_cap) OVER (PARTITION BY date, leg) AS capacity FROM secf) f USING (date, leg, sector)")
oracle.part("legs", "SELECT *, leg * fill AS weight, capacity >= 0.5::DOUBLE - 1e-9 AS feasible FROM (" + fill("parts0", "date, leg, sector", "mag", "cap", "allot", "fill") + ")")
oracle.part("bal", """
SELECT * REPLACE (CASE WHEN uneven AND CASE WHEN weight > 0 THEN l ELSE s END > least(l, s)
    THEN weight * least(l, s) / CASE WHEN weight > 0 THEN l ELSE s END ELSE weight END AS weight), NOT uneven AS balanced
FROM (SELECT *, abs(l - s) > 1e-12 AND least(l, s) > 0 AS uneven FROM (SELECT *, sum(greatest(weight, 0)) OVER (PARTITION BY date) AS l,
  sum(greatest(-weight, 0)) OVER (PARTITION BY date) AS s FROM legs))
""")
oracle.part("ev", """
SELECT d.k, d.date, x.symbol, coalesce(b.weight, 0) AS w, b.symbol IS NOT NULL AS selected, g.symbol IS NOT NULL AS candidate, b.feasible, b.balanced, b.leg, b.adv_bound
FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS k FROM (SELECT DISTINCT date FROM bal)) d CROSS JOIN (SELECT DISTINCT symbol FROM bal) x
LEFT JOIN bal b ON b.date = d.date AND b.symbol = x.symbol LEFT JOIN sig g ON g.date = d.date AND g.symbol = x.symbol
""")
oracle.part("fold", """
WITH RECURSIVE r AS (
SELECT DISTINCT symbol, -1::BIGINT AS k, 0.0::DOUBLE AS prev_weight, 0.0::DOUBLE AS weight, false AS banded FROM ev
UNION ALL SELECT symbol, k, p, CASE WHEN NOT candidate THEN 0 WHEN abs(w - p) < 0.01::DOUBLE THEN p ELSE w END, candidate AND abs(w - p) < 0.01::DOUBLE
FROM (SELECT e.*, CASE WHEN abs(r.weight) > 1e-12 THEN r.weight ELSE 0 END AS p FROM r JOIN ev e ON e.symbol = r.symbol AND e.k = r.k + 1))
SELECT * FROM r
""")
oracle.part("fin", """
SELECT e.date, e.symbol, f.prev_weight, f.weight, e.candidate, f.banded, coalesce(c.sector, 'NA') AS sector, a.adv, e.feasible, e.balanced, e.leg, e.adv_bound
FROM fold f JOIN ev e ON e.symbol = f.symbol AND e.k = f.k LEFT JOIN sectors c ON c.symbol = e.symbol LEFT JOIN advd a ON a.symbol = e.symbol AND a.date = e.date
WHERE e.selected OR f.prev_weight <> 0
""")


def _signal(t: Inputs):
    gates = stage(_gates(t), "gates")
    weights = S.trailing_weights(S.gated_ic(t.ic4, gates), t.sessions, COMPOSITE)
    return S.composite(S.gated_panel(t.study.panel, gates, len(t.library)), weights, COMPOSITE, len(t.library))


def _adv(t: Inputs):
    return windows.average_daily_value(t.px, COSTS.adv_window)


def _selected(t: Inputs):
    return portfolio.select_names(stage(_signal(t), "signal"), CONSTRUCTION, tie_code=tables.symbol_code())


def _capped(t: Inputs):
    return portfolio.name_caps(_selected(t), _adv(t), CONSTRUCTION)


def _balanced(t: Inputs):
    return portfolio.balance_legs(portfolio.project_legs(_capped(t), t.sectors, CONSTRUCTION), CONSTRUCTION)


def _book(t: Inputs) -> portfolio.Book:
    return portfolio.build_book(
        _signal(t), _adv(t), t.sectors, CONSTRUCTION, COSTS, carry=True, tie_code=tables.symbol_code()
    )


@query("s6_selection", "date symbol base:9 k:i n_candidates:i", "sel")
def _(t: Inputs):
    return _selected(t)


@query("s7_name_caps", "date symbol cap:9 adv_bound", "caps")
def _(t: Inputs):
    return _capped(t)


oracle.part("wf", "SELECT date, leg, symbol, mag, cap, 0.5::DOUBLE AS target FROM caps")


@query(
    "s8_water_fill",
    "date leg:i symbol filled:9",
    "SELECT date, leg, symbol, filled FROM (" + fill("wf", "date, leg", "mag", "cap", "target", "filled") + ")",
)
def _(t: Inputs):
    """Both legs of every date; a group holds at most ``top_n`` selected names."""
    rows = _capped(t).withColumns(
        {"leg": F.signum("base").cast("int"), "mag": F.abs("base"), "target": F.lit(0.5)}
    )
    return portfolio.water_fill(rows, ["date", "leg"], "mag", "cap", "target", "filled")


@query("s9_leg_projection", "date symbol leg:i sector weight:9 allot:9 capacity:9 feasible", "legs")
def _(t: Inputs):
    return portfolio.project_legs(_capped(t), t.sectors, CONSTRUCTION)


@query(
    "s10_cap_redistribute",
    "strategy pos:i symbol weight:9",
    """SELECT strategy, pos, symbol, sign(weight) * (least(abs(weight), 0.003::DOUBLE) + coalesce(least(spare, excess * spare / nullif(room, 0)), 0)) AS weight
       FROM (SELECT *, sum(greatest(abs(weight) - 0.003::DOUBLE, 0)) OVER g AS excess, sum(spare) OVER g AS room FROM
         (SELECT strategy, pos, symbol, book AS weight, greatest(0.003::DOUBLE - abs(book), 0) AS spare FROM bk WHERE pos < (SELECT p FROM lastpos) AND abs(book) > 1e-9)
         WINDOW g AS (PARTITION BY strategy, pos, sign(weight)))""",
)
def _(t: Inputs):
    held = B.sleeve_positions(t.targets, t.sessions, BOOK.holding).filter(F.abs("book") > 1e-9)
    rows = held.select("strategy", "pos", "symbol", F.col("book").alias("weight"))
    return portfolio.cap_and_redistribute(rows, ["strategy", "pos"], "weight", 0.003)


@query("s11_leg_balance", "date symbol weight:9 balanced", "bal")
def _(t: Inputs):
    return _balanced(t)


@query("s12_rebalance_band", "date symbol prev_weight:9 weight:9 candidate banded", "fin")
def _(t: Inputs):
    return _book(t).positions


@query(
    "s13_constraint_checks",
    "date gross:8 net:8 max_abs_weight:8 n_long:i n_short:i feasible legs_balanced n_adv_bound:i n_without_adv:i n_banded:i worst_sector_share:8 n_sectors:i ok_max_weight ok_sector_cap ok_gross ok_neutral",
    """SELECT *, max_abs_weight <= 0.08::DOUBLE + 1e-9 AS ok_max_weight, n_sectors <= 1 OR coalesce(worst_sector_share, 0) <= 0.25::DOUBLE + 1e-9 AS ok_sector_cap,
         feasible AND legs_balanced AND abs(gross - 1) <= 1e-6 AS ok_gross, abs(net) <= 1e-6 AS ok_neutral FROM (
       SELECT f.date, sum(abs(weight)) AS gross, sum(weight) AS net, max(abs(weight)) AS max_abs_weight, count(*) FILTER (weight > 1e-12) AS n_long,
         count(*) FILTER (weight < -1e-12) AS n_short, bool_and(coalesce(feasible, true)) AS feasible, bool_and(coalesce(balanced, true)) AS legs_balanced,
         count(*) FILTER (adv_bound) AS n_adv_bound, count(*) FILTER (leg IS NOT NULL AND coalesce(adv, 0) <= 0) AS n_without_adv,
         count(*) FILTER (banded) AS n_banded FROM fin f WHERE candidate GROUP BY 1)
       LEFT JOIN (SELECT date, CASE WHEN sum(s) > 0 THEN max(s) / sum(s) END AS worst_sector_share FROM (SELECT date, sector, sum(abs(weight)) AS s FROM fin WHERE candidate GROUP BY 1, 2) GROUP BY 1) USING (date)
       LEFT JOIN (SELECT date, count(DISTINCT coalesce(sector, 'NA')) AS n_sectors FROM sig LEFT JOIN sectors USING (symbol) GROUP BY 1) USING (date)""",
)
def _(t: Inputs):
    return _book(t).checks


oracle.part("trd", """
SELECT date, symbol, prev_weight, weight AS target_weight, weight - prev_weight AS delta_weight, CASE WHEN weight > prev_weight THEN 'BUY' ELSE 'SELL' END AS side,
  CASE WHEN adv > 0 THEN adv END AS adv, CASE WHEN adv > 0 THEN abs(weight - prev_weight) * 196613.0::DOUBLE / adv END AS participation,
  CASE WHEN weight > prev_weight THEN 4.5::DOUBLE ELSE 13.0::DOUBLE END + CASE WHEN adv > 0 THEN 1e3 * sqrt(abs(weight - prev_weight) * 196613.0::DOUBLE / adv) ELSE 0 END AS cost_bps
FROM fin WHERE abs(weight - prev_weight) > 1e-12
""")


@query("s14_trades", "date symbol prev_weight:9 target_weight:9 delta_weight:9 side adv:5 participation:7 cost_bps:5", "trd")
def _(t: Inputs):
    return _book(t).trades


@query(
    "s14_trade_totals",
    "date turnover:8 total_cost_bps:5 n_trades:i",
    "SELECT date, sum(abs(delta_weight)) AS turnover, sum(abs(delta_weight) * cost_bps) AS total_cost_bps, count(*) AS n_trades FROM trd GROUP BY 1",
)
def _(t: Inputs):
    return portfolio.trade_totals(_book(t).trades)


@query(
    "s15_holdings_state",
    "as_of:d symbol weight:9",
    "SELECT date AS as_of, symbol, weight FROM fin WHERE abs(weight) > 1e-12 AND date = (SELECT max(date) FROM fin WHERE date < DATE '1998-01-01' AND abs(weight) > 1e-12)",
)
def _(t: Inputs):
    root = scratch_dir(t.spark, "holdings")
    portfolio.save_holdings(_book(t).holdings, root)
    return portfolio.load_holdings(t.spark, root, "1998-01-01")


@query(
    "s15_hold_unchanged",
    "date as_of:d n_names:i",
    """SELECT s.date, a.as_of, (SELECT count(*) FROM fin b WHERE b.date = a.as_of AND abs(b.weight) > 1e-12) AS n_names FROM sessions s
       ASOF JOIN (SELECT DISTINCT date AS as_of FROM fin WHERE abs(weight) > 1e-12) a ON s.date >= a.as_of""",
)
def _(t: Inputs):
    """The book in force on every session, those without a signal included."""
    kept = portfolio.carry_forward(_book(t).holdings.select("date", "symbol", "weight"), t.sessions)
    return kept.groupBy("date", "as_of").agg(F.count(F.lit(1)).alias("n_names"))


@query(
    "st2_daily_decisions",
    "date symbol prev_weight:6 weight:6 banded cost_bps:4 decided",
    """SELECT f.date, f.symbol, f.prev_weight, f.weight, f.banded, t.cost_bps, true AS decided FROM fin f LEFT JOIN trd t ON t.date = f.date AND t.symbol = f.symbol
       UNION ALL SELECT s.date, symbol, weight, weight, false, NULL, false FROM (SELECT s.date, max(f.date) AS as_of FROM sessions s JOIN fin f ON f.date <= s.date GROUP BY 1) s
         JOIN fin f ON f.date = s.as_of AND s.date > s.as_of WHERE abs(weight) > 1e-12""",
)
def _(t: Inputs):
    """All sessions arrive as a stream in order, several to a batch."""
    root = scratch_dir(t.spark, "daily")
    third = t.sessions.count() // 3 + 1
    for k in range(3):  # files arrive in the order of their sessions
        part = t.sessions.filter(F.floor(F.col("pos") / third) == k).select("date")
        part.coalesce(1).write.mode("append").parquet(f"{root}/in")
    desk = DailyDesk(
        t.sessions, t.study.prices, t.study.panel, stage(t.labels, "labels"), stage(windows.average_daily_value(t.px, COSTS.adv_window), "adv"),
        stage(t.sectors, "sectors"), COMPOSITE, REGIME, CONSTRUCTION, COSTS, MIN_NAMES, tables.symbol_code(),
    )
    arrivals = incremental.file_stream(t.spark, f"{root}/in", "date date", files_per_batch=1)
    return incremental.daily_decisions(t.spark, arrivals, desk, f"{root}/out", f"{root}/state")


@query(
    "s16_factor_cards",
    "factor horizon:i mean_ic:8 ic_ir:7 t_stat:6 hit_rate:8 n_dates:i gross_sharpe:7 net_sharpe:7 annual_turnover:7 total_cost_bps:6 n_trials:i dsr:7",
    """SELECT i.factor, i.horizon, i.mean_ic, i.ic_ir, i.t_stat, i.hit_rate, i.n_dates, b.gross_sharpe, b.net_sharpe, b.annual_turnover,
         b.total_cost_bps, d.n_trials, d.dsr FROM ictab i JOIN bsum b ON b.strategy = i.factor JOIN dsr d ON d.strategy = i.factor WHERE i.horizon = 4""",
)
def _(t: Inputs):
    summary = B.summarize_backtest(t.daily, ["strategy"])
    return studies.factor_cards(studies.ic_table(t.study, MIN_NAMES), summary, t.daily, 4, trial_count(t))


# -- quality -----------------------------------------------------------------------------

QUALITY = "check status n_total:i n_bad:i fraction:9"


def _verdict(name: str, limit: float, total: str, bad: str, source: str) -> str:
    return f"""SELECT '{name}' AS "check", CASE WHEN f > {limit} THEN 'FAIL' WHEN f > {limit / 2} THEN 'WARN' ELSE 'PASS' END AS status, n_total, n_bad, f AS fraction
      FROM (SELECT *, n_bad / n_total::DOUBLE AS f FROM (SELECT {total} AS n_total, {bad} AS n_bad FROM {source}))"""


Q1 = _verdict("missing_trading_days", 0.02, "count(*)", "count(*) FILTER (date NOT IN (SELECT date FROM px))", "sessions")
Q2 = _verdict("per_stock_coverage", 0.10, "count(*)", "count(*) FILTER (gap > 0.05)", "gaps")
Q3 = _verdict("return_outliers", 0.01, "count(*)", "count(*) FILTER (abs(ret) > 0.4)", "rowret")
Q4 = _verdict("flows_daily_gaps", 0.05, "count(*)", "count(*) FILTER (date NOT IN (SELECT date FROM flows))", "sessions")
Q6 = """SELECT 'adjustment_sanity' AS "check", CASE WHEN n_bad > 0 THEN 'FAIL' ELSE 'PASS' END AS status, n_total, n_bad, n_bad / n_total::DOUBLE AS fraction
  FROM (SELECT count(*) AS n_total, count(*) FILTER (NOT coalesce(adj_factor > 0, false) OR adj_close IS NULL) AS n_bad FROM px)"""
oracle.part("gaps", """
SELECT symbol, max(pos) - min(pos) + 1 AS span_sessions, count(*) AS n_rows,
  greatest(0, max(pos) - min(pos) + 1 - count(*)) / (max(pos) - min(pos) + 1)::DOUBLE AS gap FROM px JOIN sessions USING (date) GROUP BY 1
""")
oracle.part("rowret", "SELECT * FROM (SELECT date, symbol, adj_close / lag(adj_close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret FROM px) WHERE ret IS NOT NULL")
oracle.part("card", """
SELECT d AS rebalance_date, (SELECT count(*) FROM (SELECT symbol FROM px WHERE date <= d GROUP BY 1 HAVING count(*) >= 26)) AS n_members
FROM (SELECT max(date) AS d FROM sessions GROUP BY date_trunc('quarter', date))
""")
Q5 = """SELECT 'universe_cardinality' AS "check", CASE WHEN md NOT BETWEEN 80 AND 120 THEN 'FAIL' WHEN f < 80 OR l > 120 THEN 'WARN' ELSE 'PASS' END AS status,
  n_total, n_bad, n_bad / n_total::DOUBLE AS fraction FROM (SELECT count(*) AS n_total, count(*) FILTER (n_members NOT BETWEEN 80 AND 120) AS n_bad,
  quantile_cont(n_members, 0.5::DOUBLE) AS md, arg_min(n_members, rebalance_date) AS f, arg_max(n_members, rebalance_date) AS l FROM card)"""


@query("q1_missing_sessions", QUALITY, Q1)
def _(t: Inputs):
    return quality.check_missing_sessions(t.px, t.sessions)


@query("q2_name_coverage", QUALITY, Q2)
def _(t: Inputs):
    return quality.check_name_coverage(t.px, t.sessions)


@query(
    "q2_worst_names",
    "symbol span_sessions:i n_rows:i gap_fraction:9",
    "SELECT *, gap AS gap_fraction FROM gaps WHERE gap > 0.05 ORDER BY gap DESC, symbol LIMIT 10",
)
def _(t: Inputs):
    return quality.worst_names(t.px, t.sessions)


@query("q3_return_outliers", QUALITY, Q3)
def _(t: Inputs):
    return quality.check_return_outliers(t.px)


@query("q3_worst_returns", "date symbol ret:9", "SELECT * FROM rowret WHERE abs(ret) > 0.4 ORDER BY abs(ret) DESC, date, symbol LIMIT 10")
def _(t: Inputs):
    return quality.worst_returns(t.px)


@query("q4_series_gaps", QUALITY, Q4)
def _(t: Inputs):
    return quality.check_series_gaps(t.flows, t.sessions)


@query("q5_universe_cardinality", "rebalance_date:d n_members:i", "card")
def _(t: Inputs):
    return quality.universe_cardinality(t.px, t.sessions, min_history=26)


@query("q5_universe_check", QUALITY, Q5)
def _(t: Inputs):
    return quality.check_universe(t.px, t.sessions, (80, 120), min_history=26)


@query("q6_adjustment_sanity", QUALITY, Q6)
def _(t: Inputs):
    return quality.check_adjustment(t.px)


EVERY = " UNION ALL ".join(f"SELECT * FROM ({q})" for q in (Q1, Q2, Q3, Q4, Q5, Q6))


@query("q7_all_checks", QUALITY, EVERY)
def _(t: Inputs):
    return quality.run_checks(t.px, t.sessions, flows=t.flows, band=(80, 120), min_history=26)


@query(
    "q7_overall",
    "status n_checks:i",
    f"SELECT CASE WHEN bool_or(status = 'FAIL') THEN 'FAIL' WHEN bool_or(status = 'WARN') THEN 'WARN' ELSE 'PASS' END AS status, count(*) AS n_checks FROM ({EVERY})",
)
def _(t: Inputs):
    return quality.overall_status(quality.run_checks(t.px, t.sessions, flows=t.flows, band=(80, 120), min_history=26))
