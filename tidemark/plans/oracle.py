"""Reference SQL of the registered queries, assembled from shared named sub-queries.

Written against dense session x symbol grids and plain windows, independently of the Spark
formulation. ``sql(text)`` prefixes ``text`` with the sub-queries it mentions.
"""

from __future__ import annotations

import re

PARTS: dict[str, str] = {}


def part(name: str, text: str) -> None:
    PARTS[name] = text.strip()


def _mentioned(text: str) -> list[str]:
    return [n for n in PARTS if re.search(rf"\b{n}\b", text)]


def sql(text: str) -> str:
    needed: set[str] = set()
    todo = _mentioned(text)
    while todo:
        name = todo.pop()
        if name not in needed:
            needed.add(name)
            todo += [m for m in _mentioned(PARTS[name]) if m != name]
    prefix = ",\n".join(f"{n} AS ({PARTS[n]})" for n in PARTS if n in needed)
    return (f"WITH {prefix}\n" if prefix else "") + text.strip()


def r(expr: str, digits: int = 6) -> str:
    """Rounded double without negative zero."""
    return f"(round({expr}, {digits}) + 0.0::DOUBLE)"


def newey_west(source: str, keys: str, value: str, order: str, lags: str) -> str:
    """Per key: n, mean, sd, nw_lags, se (Bartlett). ``lags`` may use n and the keys."""
    on = " AND ".join(f"a.{k.strip()} IS NOT DISTINCT FROM b.{k.strip()}" for k in keys.split(","))
    ak = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    return f"""
    WITH s AS (SELECT {keys}, {value} AS v, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS i
               FROM {source} WHERE {value} IS NOT NULL),
    m0 AS (SELECT {keys}, count(*) AS n, avg(v) AS mean, stddev_samp(v) AS sd FROM s GROUP BY {keys}),
    m AS (SELECT *, CASE WHEN n >= 2 THEN greatest(0, least(({lags})::BIGINT, n - 1)) ELSE 0 END AS nw_lags FROM m0),
    z AS (SELECT s.*, s.v - b.mean AS z, b.n, b.nw_lags FROM s s JOIN m b ON {on.replace('a.', 's.')}),
    g0 AS (SELECT {keys}, sum(z * z) AS ss FROM z GROUP BY {keys}),
    gk AS (SELECT {ak}, sum(2.0 * (1.0 - (a.i - b.i) / (a.nw_lags + 1.0)) * a.z * b.z / a.n) AS add
           FROM z a JOIN z b ON {on} AND a.i > b.i AND a.i - b.i <= a.nw_lags GROUP BY {ak})
    SELECT m.*, CASE WHEN n < 2 THEN NULL
        WHEN ss / n + coalesce(add, 0) > 0 THEN sqrt((ss / n + coalesce(add, 0)) / n)
        ELSE sqrt(ss / (n - 1)) / sqrt(n) END AS se
    FROM m JOIN g0 a ON {on.replace('b.', 'm.')} LEFT JOIN gk b ON {on.replace('a.', 'm.')}
    """


AUTO = "floor(4.0 * pow(n / 100.0, 2.0 / 9.0))"

# -- logical tables ----------------------------------------------------------------------
part("bars", """
SELECT date_trunc('week', l_shipdate)::DATE AS date,
       'S' || lpad(l_suppkey::VARCHAR, 12, '0') AS symbol,
       sum(floor(l_extendedprice * 1e2 + 5e-1)::BIGINT)::DOUBLE / (sum(l_quantity::BIGINT) * 1e2) AS close,
       sum(floor(l_discount * 1e2 + 5e-1)::BIGINT)::DOUBLE / (count(*) * 1e2) AS disc,
       max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
       sum(l_quantity::BIGINT)::DOUBLE AS volume,
       (sum((l_returnflag = 'N')::INT) * 100 // count(*))::DOUBLE AS delivery_pct
FROM lineitem GROUP BY 1, 2, l_suppkey
""")
part("px", """
SELECT date, symbol, close AS open, high, low, close, close * (1 - disc) AS adj_close, volume, delivery_pct,
       close * (1 - disc) / close AS adj_factor, close * volume AS turnover
FROM bars
""")
part("sessions", "SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT date FROM px)")
part("lastpos", "SELECT max(pos) AS p FROM sessions")
part("pos_flows", """
SELECT date_trunc('week', o_orderdate)::DATE AS date,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'FII' WHEN '2-HIGH' THEN 'DII' WHEN '3-MEDIUM' THEN 'Client'
            WHEN '4-NOT SPECIFIED' THEN 'Pro' ELSE 'TOTAL' END AS participant,
       sum(CASE WHEN o_orderstatus <> 'O' THEN floor(o_totalprice * 1e2 + 5e-1)::BIGINT ELSE 0 END) / 1e2 AS long,
       sum(CASE WHEN o_orderstatus = 'O' THEN floor(o_totalprice * 1e2 + 5e-1)::BIGINT ELSE 0 END) / 1e2 AS short,
       sum(CASE WHEN o_orderstatus <> 'O' THEN 1 ELSE -1 END * floor(o_totalprice * 1e2 + 5e-1)::BIGINT) / 1e2 AS net
FROM orders GROUP BY 1, 2
""")
part("flows", "SELECT date, participant, long, short, net AS net_futures FROM pos_flows WHERE participant <> 'TOTAL'")
part("sectors", """
SELECT 'S' || lpad(s_suppkey::VARCHAR, 12, '0') AS symbol, r_name AS sector
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""")
part("shares", "SELECT 'S' || lpad(s_suppkey::VARCHAR, 12, '0') AS symbol, s_acctbal AS shares FROM supplier WHERE s_acctbal > 0")
part("grid", """
SELECT s.date, s.pos, n.symbol, p.adj_close, p.close, p.volume, p.turnover, p.delivery_pct
FROM sessions s CROSS JOIN (SELECT DISTINCT symbol FROM px) n LEFT JOIN px p ON p.date = s.date AND p.symbol = n.symbol
""")
part("gret", """
SELECT *, adj_close / lag(adj_close) OVER (PARTITION BY symbol ORDER BY pos) - 1 AS ret FROM grid
""")
part("fac", """
SELECT date, pos, symbol,
  CASE WHEN lag(adj_close, 30) OVER w > 0 THEN lag(adj_close, 4) OVER w / lag(adj_close, 30) OVER w - 1 END AS momentum,
  CASE WHEN lag(adj_close, 4) OVER w > 0 THEN -(adj_close / lag(adj_close, 4) OVER w - 1) END AS reversal_4d,
  CASE WHEN lag(adj_close, 12) OVER w > 0 THEN -(adj_close / lag(adj_close, 12) OVER w - 1) END AS reversal_12d,
  CASE WHEN count(ret) OVER w12 >= 7 AND pos >= 11 THEN -stddev_samp(ret) OVER w12 END AS low_volatility,
  CASE WHEN count(CASE WHEN turnover > 0 THEN abs(ret) / turnover END) OVER w8 >= 4 AND pos >= 7
       THEN avg(CASE WHEN turnover > 0 THEN abs(ret) / turnover END) OVER w8 * 1e9 END AS illiquidity,
  CASE WHEN count(delivery_pct) OVER w8 >= 4 AND pos >= 7 THEN avg(delivery_pct) OVER w8 END AS delivery_ratio,
  CASE WHEN close > 0 THEN ln(close) END AS size_logprice_proxy,
  CASE WHEN count(volume) OVER w8 >= 4 AND pos >= 15 AND count(volume) OVER w8b >= 4
       THEN ln(avg(volume) OVER w8 / avg(volume) OVER w8b) END AS volume_trend
FROM gret
WINDOW w AS (PARTITION BY symbol ORDER BY pos),
       w12 AS (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 11 PRECEDING AND CURRENT ROW),
       w8 AS (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 7 PRECEDING AND CURRENT ROW),
       w8b AS (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 15 PRECEDING AND 8 PRECEDING)
""")
FACTORS = (
    "momentum", "reversal_4d", "reversal_12d", "low_volatility", "illiquidity",
    "delivery_ratio", "size_logprice_proxy", "volume_trend",
)
part("fl", " UNION ALL ".join(
    f"SELECT '{f}' AS factor, date, pos, symbol, {f} AS value FROM fac WHERE {f} IS NOT NULL" for f in FACTORS
))


def treated(source: str, keys: str) -> str:
    """Winsorised and standardised values of ``source(keys, symbol, value)``."""
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    return f"""
    WITH q AS (SELECT {keys}, quantile_cont(value, 0.01::DOUBLE) AS lo, quantile_cont(value, 0.99::DOUBLE) AS hi
               FROM {source} GROUP BY {keys}),
    c AS (SELECT a.* REPLACE (least(greatest(a.value, b.lo), b.hi) AS value) FROM {source} a JOIN q b ON {on}),
    t AS (SELECT {keys}, avg(value) AS m, stddev_samp(value) AS s, max(abs(value)) AS mx, count(*) AS n FROM c GROUP BY {keys})
    SELECT a.* REPLACE (CASE WHEN n >= 2 AND s > 1e-12 * greatest(mx, 1e-300) THEN (a.value - m) / s END AS value)
    FROM c a JOIN t b ON {on}
    """


part("panel", treated("fl", "factor, date"))
part("lab", """
SELECT * FROM (SELECT date, pos, symbol, adj_close,
  lead(adj_close, 1) OVER w / adj_close - 1 AS fwd_1,
  lead(adj_close, 4) OVER w / adj_close - 1 AS fwd_4,
  lead(adj_close, 12) OVER w / adj_close - 1 AS fwd_12
FROM grid WINDOW w AS (PARTITION BY symbol ORDER BY pos)) WHERE adj_close IS NOT NULL
""")
part("labl", " UNION ALL ".join(
    f"SELECT {h} AS horizon, date, symbol, fwd_{h} AS ret FROM lab WHERE fwd_{h} IS NOT NULL" for h in (1, 4, 12)
))


def rank_ic(panel: str, labels: str, keys: str, own: str, min_names: int = 5) -> str:
    return f"""
    WITH j AS (SELECT {keys}, a.symbol, a.value AS x, b.ret AS y FROM {panel} a JOIN {labels} b
               ON a.date = b.date AND a.symbol = b.symbol WHERE a.value IS NOT NULL),
    k AS (SELECT *, rank() OVER (PARTITION BY {own} ORDER BY x) + (count(*) OVER (PARTITION BY {own}, x) - 1) / 2.0::DOUBLE AS rx,
                 rank() OVER (PARTITION BY {own} ORDER BY y) + (count(*) OVER (PARTITION BY {own}, y) - 1) / 2.0::DOUBLE AS ry FROM j)
    SELECT {own}, CASE WHEN stddev_pop(rx) > 0 AND stddev_pop(ry) > 0
                       THEN covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) END AS ic, count(*) AS n
    FROM k GROUP BY {own} HAVING count(*) >= {min_names}
    """


part("ic", rank_ic("panel", "labl", "a.factor, b.horizon, a.date", "factor, horizon, date"))
part("ic4", "SELECT factor, date, ic, n FROM ic WHERE horizon = 4")
part("icnw", newey_west("ic", "factor, horizon", "ic", "date", f"greatest(horizon - 1, {AUTO})"))
part("ictab", """
SELECT a.factor, a.horizon, a.n AS n_dates, a.mean AS mean_ic, a.sd AS std_ic,
       CASE WHEN a.sd > 0 THEN a.mean / a.sd END AS ic_ir, CASE WHEN a.se > 0 THEN a.mean / a.se END AS t_stat,
       a.nw_lags, b.hit_rate, b.mean_names
FROM icnw a JOIN (SELECT factor, horizon, avg((ic > 0)::INT::DOUBLE) AS hit_rate, avg(n) AS mean_names
                  FROM ic GROUP BY 1, 2) b ON a.factor = b.factor AND a.horizon = b.horizon
""")
# -- flow features and regimes -----------------------------------------------------------
part("fs", """
SELECT s.date, s.pos, v.series, f.net_futures AS value
FROM sessions s CROSS JOIN (VALUES ('fii', 'FII'), ('dii', 'DII'), ('retail', 'Client')) v(series, who)
LEFT JOIN flows f ON f.date = s.date AND f.participant = v.who
""")
part("fu", "SELECT *, lag(value) OVER (PARTITION BY series ORDER BY pos) AS daily FROM fs")
part("ff", """
SELECT *, abs(daily) AS size, CASE WHEN count(daily) OVER w = 8 THEN sum(daily) OVER w END AS flow FROM fu
WINDOW w AS (PARTITION BY series ORDER BY pos ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)
""")
part("fh", """
SELECT a.series, a.pos, count(b.flow) AS n, count(*) FILTER (b.flow < a.flow) AS lo, count(*) FILTER (b.flow <= a.flow) AS hi
FROM ff a JOIN ff b ON a.series = b.series AND b.pos <= a.pos WHERE a.flow IS NOT NULL GROUP BY 1, 2
""")
part("fx", """
SELECT a.series, a.pos, count(b.size) AS n, count(*) FILTER (b.size <= a.size) AS hi
FROM ff a JOIN ff b ON a.series = b.series AND b.pos <= a.pos WHERE a.size IS NOT NULL GROUP BY 1, 2
""")
part("flab", """
SELECT ff.date, ff.pos, ff.series, ff.daily, ff.flow,
  CASE WHEN fh.n >= 52 THEN ['low', 'mid', 'high'][least(floor((fh.lo + fh.hi) / (2.0 * fh.n) * 3)::INT, 2) + 1] END AS regime,
  CASE WHEN fx.n >= 52 THEN fx.hi >= greatest(1, least(fx.n, ceil(0.95::DOUBLE * fx.n))) END AS shock
FROM ff LEFT JOIN fh USING (series, pos) LEFT JOIN fx USING (series, pos)
""")
part("feat", """
SELECT date, pos, fii_flow, dii_flow, retail_flow, fii_daily, retail_daily, fii_regime, retail_regime,
  CASE WHEN retail_regime IS NOT NULL THEN CASE WHEN retail_regime = 'mid' THEN 'mid' ELSE 'extreme' END END AS retail_extreme,
  CASE WHEN fii_flow IS NOT NULL AND dii_flow IS NOT NULL THEN
    CASE WHEN fii_flow = 0 OR dii_flow = 0 THEN 'neutral' WHEN sign(fii_flow) = sign(dii_flow) THEN 'aligned' ELSE 'opposed' END END AS flow_divergence,
  flow_shock
FROM (SELECT date, pos, max(flow) FILTER (series = 'fii') AS fii_flow, max(flow) FILTER (series = 'dii') AS dii_flow,
  max(flow) FILTER (series = 'retail') AS retail_flow, max(daily) FILTER (series = 'fii') AS fii_daily,
  max(daily) FILTER (series = 'retail') AS retail_daily, max(regime) FILTER (series = 'fii') AS fii_regime,
  max(regime) FILTER (series = 'retail') AS retail_regime, bool_or(shock) FILTER (series = 'fii') AS flow_shock
  FROM flab GROUP BY 1, 2)
""")
part("lbl", " UNION ALL ".join(
    f"SELECT date, '{c}' AS regime_column, {c}::VARCHAR AS regime FROM feat WHERE {c} IS NOT NULL"
    for c in ("fii_regime", "retail_regime", "retail_extreme", "flow_divergence", "flow_shock")
))
part("cic", "SELECT i.factor, l.regime_column, l.regime, i.date, i.ic, i.n AS names FROM ic4 i JOIN lbl l USING (date)")
part("cicnw", newey_west("cic", "factor, regime_column, regime", "ic", "date", f"greatest(3, {AUTO})"))
part("cexp", newey_west("cic", "factor, regime_column, regime", "ic", "date", AUTO))
part("fmap", """
SELECT f.factor, m.prefix, m.regime_column, m.favourable, m.unfavourable
FROM (SELECT DISTINCT factor FROM ic4) f
JOIN (VALUES ('momentum', 'fii_regime', 'high', 'low'), ('reversal', 'retail_extreme', 'extreme', 'mid'))
  m(prefix, regime_column, favourable, unfavourable) ON starts_with(f.factor, m.prefix)
""")
part("expr", """
SELECT *, difference / se_difference AS t_stat,
  coalesce(n_favourable >= 30 AND n_unfavourable >= 30 AND difference > 0 AND difference / se_difference >= 1.5, false) AS supported
FROM (SELECT m.factor, m.regime_column, a.mean AS ic_favourable, b.mean AS ic_unfavourable, a.n AS n_favourable,
  b.n AS n_unfavourable, a.mean - b.mean AS difference, sqrt(a.se * a.se + b.se * b.se) AS se_difference,
  (SELECT avg(ic) FROM ic4 i WHERE i.factor = m.factor) AS unconditional_ic
  FROM fmap m JOIN cexp a ON a.factor = m.factor AND a.regime_column = m.regime_column AND a.regime = m.favourable
  JOIN cexp b ON b.factor = m.factor AND b.regime_column = m.regime_column AND b.regime = m.unfavourable)
""")
part("expp", """
SELECT *, 0.5 * abs(unconditional_ic) AS reference_effect, abs(difference) AS observed_difference,
  1.5 * se_difference AS detectable_50, (1.5 + 0.8416212335729143::DOUBLE) * se_difference AS mde,
  (1.5 + 0.8416212335729143::DOUBLE) * se_difference / abs(unconditional_ic) AS mde_over_ic,
  0.5 * abs(unconditional_ic) / se_difference - 1.5 AS z_reference, abs(difference) / se_difference - 1.5 AS z_observed
FROM expr
""")


def phi(z: str) -> str:
    """Standard normal distribution function as a power series (all terms positive)."""
    a = f"least(abs({z}), 8.0)"
    series = (
        f"list_sum(list_transform(range(0, 160), lambda k: exp((2 * k + 1) * ln(greatest({a}, 1e-12)) - "
        f"(lgamma(2 * k + 2) - k * ln(2.0) - lgamma(k + 1)))))"
    )
    upper = f"(0.5 + exp(-{a} * {a} / 2) / sqrt(2 * pi()) * {series})"
    return f"(CASE WHEN ({z}) IS NULL THEN NULL WHEN ({z}) >= 0 THEN {upper} ELSE 1 - {upper} END)"


part("exppw", f"SELECT *, {phi('z_reference')} AS power_at_reference, {phi('z_observed')} AS power_at_observed FROM expp")

# -- backtest ----------------------------------------------------------------------------
part("tails", """
SELECT factor AS strategy, date, pos, symbol,
  CASE WHEN n < 5 THEN 0 WHEN rn > n - greatest(1, n // 5) THEN 0.025::DOUBLE / greatest(1, n // 5)
       WHEN rn <= greatest(1, n // 5) THEN -0.025::DOUBLE / greatest(1, n // 5) ELSE 0 END AS weight
FROM (SELECT *, row_number() OVER (PARTITION BY factor, date ORDER BY value, symbol) AS rn,
        count(*) OVER (PARTITION BY factor, date) AS n FROM panel WHERE value IS NOT NULL)
""")
part("strategies", "SELECT DISTINCT factor AS strategy FROM fl")
part("mkt", """
SELECT g.symbol, g.pos, lead(g.adj_close) OVER (PARTITION BY g.symbol ORDER BY g.pos) / g.adj_close - 1 AS step, a.adv
FROM grid g LEFT JOIN (SELECT date, symbol, CASE WHEN count(turnover) OVER w >= 4 THEN avg(turnover) OVER w END AS adv FROM px
  WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)) a ON a.date = g.date AND a.symbol = g.symbol
""")


def book(targets: str, keys: str) -> str:
    """Sleeve book, unit book and trades on the dense grid of every key that ever trades."""
    on = " AND ".join(f"t.{k.strip()} = n.{k.strip()}" for k in keys.split(","))
    nk = ", ".join(f"n.{k.strip()}" for k in keys.split(","))
    return f"""
    WITH d AS (SELECT {nk}, n.symbol, s.pos, coalesce(t.weight, 0) / 4 AS u, coalesce(t.weight * t.scale, 0) / 4 AS w
       FROM (SELECT DISTINCT {keys}, symbol FROM {targets} WHERE weight <> 0) n CROSS JOIN sessions s
       LEFT JOIN {targets} t ON {on} AND t.symbol = n.symbol AND t.pos = s.pos)
    SELECT {keys}, symbol, pos, sum(w) OVER f AS book, sum(u) OVER f AS unit_book, w - coalesce(lag(w, 4) OVER o, 0) AS delta
    FROM d WINDOW o AS (PARTITION BY {keys}, symbol ORDER BY pos),
      f AS (PARTITION BY {keys}, symbol ORDER BY pos ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)
    """


def daily(bk: str, keys: str) -> str:
    return f"""
    SELECT {keys}, b.pos, (SELECT x.date FROM sessions x WHERE x.pos = b.pos + 1) AS date,
      sum(coalesce(book * step, 0)) AS gross_return, sum(coalesce(unit_book * step, 0)) AS unit_return,
      sum(abs(delta)) AS turnover, sum(greatest(delta, 0)) AS buys, sum(greatest(-delta, 0)) AS sells,
      sum(CASE WHEN abs(delta) > 0 AND adv > 0 THEN abs(delta) * 0.1::DOUBLE * sqrt(abs(delta) / adv) ELSE 0 END) AS impact_unit,
      count(*) FILTER (abs(delta) > 0 AND coalesce(adv, 0) <= 0) AS missing_adv,
      count(*) FILTER (book > 1e-12) AS n_long, count(*) FILTER (book < -1e-12) AS n_short,
      count(*) FILTER (abs(book) > 1e-12 AND step IS NULL) AS unpriced_days,
      coalesce(sum(abs(book)) FILTER (abs(book) > 1e-12 AND step IS NULL), 0) AS unpriced_gross,
      0.00045::DOUBLE * sum(greatest(delta, 0)) + 0.0013::DOUBLE * sum(greatest(-delta, 0)) AS fixed_cost
    FROM {bk} b LEFT JOIN mkt m ON m.symbol = b.symbol AND m.pos = b.pos
    WHERE b.pos < (SELECT p FROM lastpos) GROUP BY {keys}, b.pos
    """


part("tails1", "SELECT *, 1.0::DOUBLE AS scale FROM tails")
part("bk", book("tails1", "strategy"))
part("dly", daily("bk", "strategy"))


def sized(source: str, notional: str) -> str:
    return (f"SELECT *, {notional}::DOUBLE AS notional, fixed_cost + sqrt({notional}::DOUBLE) * impact_unit AS cost, "
            f"gross_return - (fixed_cost + sqrt({notional}::DOUBLE) * impact_unit) AS net_return FROM {source}")


part("dlyn", sized("dly", "1e5"))


def drawdowns(source: str, keys: str, ret: str) -> str:
    return f"""
    WITH e AS (SELECT {keys}, pos, product(1 + {ret}) OVER w AS equity FROM {source} WHERE {ret} IS NOT NULL
               WINDOW w AS (PARTITION BY {keys} ORDER BY pos ROWS UNBOUNDED PRECEDING)),
    p AS (SELECT *, max(equity) OVER (PARTITION BY {keys} ORDER BY pos ROWS UNBOUNDED PRECEDING) AS peak FROM e),
    g AS (SELECT *, equity / peak - 1 AS drawdown, sum((equity >= peak)::INT) OVER (PARTITION BY {keys} ORDER BY pos ROWS UNBOUNDED PRECEDING) AS spell FROM p)
    SELECT {keys}, pos, equity, drawdown, count(*) FILTER (equity < peak) OVER (PARTITION BY {keys}, spell ORDER BY pos ROWS UNBOUNDED PRECEDING) AS under_run FROM g
    """


def summary(source: str, keys: str) -> str:
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    def sh(side):
        return (f"CASE WHEN count(*) >= 2 AND stddev_samp({side}) > 1e-12 * greatest(abs(avg({side})), max(abs({side})), 1e-300) "
                f"THEN avg({side}) / stddev_samp({side}) * sqrt(252) END")
    return f"""
    WITH dd AS ({drawdowns(source, keys, 'net_return')}),
    b AS (SELECT {keys}, min(drawdown) AS max_drawdown, max(under_run) AS time_under_water FROM dd GROUP BY {keys}),
    a AS (SELECT {keys}, count(*) AS n_days, {sh('gross_return')} AS gross_sharpe, {sh('net_return')} AS net_sharpe,
      avg(gross_return) * 252 AS gross_annual_return, avg(net_return) * 252 AS net_annual_return,
      sum(turnover) / (count(*) / 252.0::DOUBLE) AS annual_turnover, 1e4 * sum(cost) / (count(*) / 252.0::DOUBLE) AS total_cost_bps,
      sum(missing_adv)::BIGINT AS trades_without_adv, sum(unpriced_days)::BIGINT AS unpriced_position_days,
      sum(unpriced_gross) AS unpriced_gross_exposure FROM {source} GROUP BY {keys})
    SELECT a.*, b.max_drawdown, b.time_under_water,
      CASE WHEN abs(b.max_drawdown) > 1e-12 THEN a.net_annual_return / abs(b.max_drawdown) END AS calmar
    FROM a JOIN b ON {on}
    """


part("bsum", summary("dlyn", "strategy"))
