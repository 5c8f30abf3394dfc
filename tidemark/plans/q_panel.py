"""Registered queries: normalisation, calendar, as-of reads, windows, factors, treatment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import finite, nan_to_null
from ..operators import asof, calendar, factors, flowfeatures, panel, windows
from ..operators import crosssection as xs
from ..sources import tables
from . import oracle
from .catalog import COSTS, FACTORS, REGIME, Inputs, query

# Columns left unrounded come from integer sums and identical arithmetic, so they agree exactly.
PRICES = "date symbol open high low close adj_close volume adj_factor adj_open adj_high adj_low turnover delivery_pct"

# -- normalisation -----------------------------------------------------------------------


@query("t1_canonical_prices", PRICES, "SELECT *, open * adj_factor AS adj_open, high * adj_factor AS adj_high, low * adj_factor AS adj_low FROM px")
def _(t: Inputs):
    return t.px


@query(
    "t2_finalise_keep_last",
    "date symbol open close adj_factor:6 adj_open volume",
    """SELECT *, close AS open, 1.0 AS adj_factor, close AS adj_open FROM (
         SELECT date_trunc('month', l_shipdate)::DATE AS date, 'S' || lpad(l_suppkey::VARCHAR, 12, '0') AS symbol,
           l_extendedprice AS close, l_quantity AS volume,
           row_number() OVER (PARTITION BY date_trunc('month', l_shipdate), l_suppkey
             ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_quantity DESC, l_extendedprice DESC) AS rn
         FROM lineitem) WHERE rn = 1""",
)
def _(t: Inputs):
    rows = t.table("lineitem").select(
        F.date_trunc("month", "l_shipdate").cast("date").alias("date"),
        tables.symbol_of("l_suppkey").alias("symbol"),
        F.col("l_extendedprice").alias("open"),
        F.col("l_extendedprice").alias("close"),
        F.col("l_quantity").alias("volume"),
        "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey",
    )
    order = [F.col(c) for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "volume", "close")]
    return panel.finalise(rows, order)


@query(
    "t3_nan_to_null",
    "l_returnflag n_missing:i n:i total:3",
    """SELECT l_returnflag, count(*) - count(v) AS n_missing, count(*) AS n, sum(v) AS total
       FROM (SELECT l_returnflag, CASE WHEN l_discount > 0 THEN l_tax / l_discount END AS v FROM lineitem) GROUP BY 1""",
)
def _(t: Inputs):
    noisy = t.table("lineitem").select(
        "l_returnflag",
        F.when(F.col("l_discount") > 0, F.col("l_tax") / F.col("l_discount")).otherwise(F.lit(float("nan"))).alias("v"),
    )
    return nan_to_null(noisy).groupBy("l_returnflag").agg(
        F.count(F.when(F.col("v").isNull(), 1)).alias("n_missing"),
        F.count(F.lit(1)).alias("n"),
        F.sum("v").alias("total"),
    )


@query(
    "t4_long_to_wide",
    "date:d FII:2 DII:2 Client:2 Pro:2",
    "PIVOT (SELECT date, participant, net_futures FROM flows) ON participant IN ('FII', 'DII', 'Client', 'Pro') USING first(net_futures) GROUP BY date",
)
def _(t: Inputs):
    return panel.to_wide(t.flows, ["FII", "DII", "Client", "Pro"], on="participant", value="net_futures")


@query("t5_dense_grid", "date symbol pos:i adj_close volume", "grid")
def _(t: Inputs):
    seen = calendar.with_position(t.px.select("date", "symbol", "adj_close", "volume"), t.sessions).drop("date")
    return panel.with_dates(panel.dense_grid(seen, t.sessions, ["symbol"]), t.sessions)


@query("t6_matrix_to_long", "date symbol value:9", "SELECT date, symbol, ret AS value FROM gret WHERE ret IS NOT NULL")
def _(t: Inputs):
    grid = factors.factor_grid(t.px, t.sessions)
    return panel.to_long(panel.with_dates(grid, t.sessions), "ret")


@query(
    "t8_institutional_flows",
    "date participant net_futures:2 gross_futures_long:2 gross_futures_short:2",
    "SELECT *, long AS gross_futures_long, short AS gross_futures_short FROM flows WHERE participant IN ('FII', 'DII')",
)
def _(t: Inputs):
    return panel.institutional_flows(t.flows)


@query("t9_align_to_sessions", "date pos:i value:2", "SELECT date, pos, value FROM fs WHERE series = 'retail'")
def _(t: Inputs):
    return panel.align_to_sessions(t.flows, t.sessions, "Client")


@query(
    "t10_stack_panels",
    "factor n:i total:3 low:6 high:6",
    """SELECT factor, count(*) AS n, sum(value) AS total, min(value) AS low, max(value) AS high FROM (
         SELECT 'price' AS factor, adj_close AS value FROM px UNION ALL SELECT 'volume', volume FROM px) GROUP BY 1""",
)
def _(t: Inputs):
    stacked = panel.stack(
        {
            "price": t.px.select("date", "symbol", F.col("adj_close").alias("value")),
            "volume": t.px.select("date", "symbol", F.col("volume").alias("value")),
        }
    )
    return stacked.groupBy("factor").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.min("value").alias("low"), F.max("value").alias("high")
    )


# -- calendar ----------------------------------------------------------------------------


@query("c1_sessions", "date", "sessions")
def _(t: Inputs):
    return calendar.sessions_from(t.px).select("date")


@query(
    "c2_ordinal",
    "date is_session n:i pos:i",
    """SELECT date, s.pos IS NOT NULL AS is_session, n, s.pos FROM (SELECT o_orderdate::DATE AS date, count(*) AS n FROM orders GROUP BY 1)
       LEFT JOIN sessions s USING (date)""",
)
def _(t: Inputs):
    days = t.table("orders").groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    return asof.membership(days, t.sessions).withColumn("is_session", F.col("pos").isNotNull())


ORDER_DAYS = "(SELECT o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY 1)"
SHIP_DAYS = "(SELECT l_shipdate::DATE AS day, count(*) AS n FROM lineitem GROUP BY 1)"
SESSION_LIST = "(SELECT list(date ORDER BY date) AS s, count(*) AS k, max(date) AS e FROM sessions)"


def _days(t: Inputs, name: str, ts: str):
    return t.table(name).groupBy(F.col(ts).cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))


WEEKDAYS_ON = """(SELECT max(x) FROM (SELECT unnest(list_slice(list_filter(
    list_transform(range(1, {reach}), lambda i: ({base})::DATE + i::INT), lambda x: isodow(x) <= 5), 1, ({steps})::INT)) AS x))"""


def _shift_sql(n: int) -> str:
    after = "len(list_filter(s, lambda x: x <= day))"
    before = "len(list_filter(s, lambda x: x < day))"
    if n > 0:
        beyond = WEEKDAYS_ON.format(
            reach=3 * n + 10, base="CASE WHEN day >= e THEN day ELSE e END",
            steps=f"CASE WHEN day >= e THEN {n} ELSE {after} + {n} - k END",
        )
        hit = f"CASE WHEN {after} + {n} <= k THEN s[{after} + {n}] ELSE {beyond} END"
    else:
        hit = f"CASE WHEN {before} + {n} >= 0 THEN s[{before} + {n} + 1] END"
    return f"SELECT day, n, {n} AS steps, {hit} AS shifted FROM {SHIP_DAYS} CROSS JOIN {SESSION_LIST}"


@query("c3_shift", "day steps:i shifted:d n:i", " UNION ALL ".join(_shift_sql(n) for n in (3, -3)) + f" UNION ALL SELECT day, n, 0, day FROM {SHIP_DAYS}")
def _(t: Inputs):
    days = _days(t, "lineitem", "l_shipdate")
    parts = [calendar.shift(days, t.sessions, "day", n).withColumn("steps", F.lit(n)) for n in (3, -3, 0)]
    cols = ["day", "steps", "shifted", "n"]
    return parts[0].select(*cols).unionByName(parts[1].select(*cols)).unionByName(parts[2].select(*cols))


@query(
    "c4_next_prev_session",
    "day next_session:d prev_session:d",
    f"""SELECT day, coalesce((SELECT min(date) FROM sessions WHERE date >= day),
            day + CASE isodow(day) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END) AS next_session,
          (SELECT max(date) FROM sessions WHERE date < day) AS prev_session FROM {ORDER_DAYS}""",
)
def _(t: Inputs):
    days = _days(t, "orders", "o_orderdate")
    ahead = calendar.next_session(days, t.sessions, "day", inclusive=True)
    return calendar.prev_session(ahead, t.sessions, "day")


@query(
    "c5_sessions_between",
    "s_suppkey:i n_between:i",
    """SELECT l_suppkey AS s_suppkey, (SELECT count(*) FROM sessions WHERE date BETWEEN a AND b) AS n_between
       FROM (SELECT l_suppkey, min(l_shipdate)::DATE AS a, max(l_shipdate)::DATE AS b FROM lineitem GROUP BY 1)""",
)
def _(t: Inputs):
    spans = t.table("lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(
        F.min("l_shipdate").cast("date").alias("a"), F.max("l_shipdate").cast("date").alias("b")
    )
    return calendar.count_between(spans, t.sessions, "a", "b", "n_between")


@query(
    "c6_holidays",
    "date",
    """SELECT d::DATE AS date FROM (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS d FROM sessions)
       WHERE isodow(d) <= 5 AND d::DATE NOT IN (SELECT date FROM sessions)""",
)
def _(t: Inputs):
    return calendar.holidays(t.sessions)


@query(
    "c7_rebalance_dates",
    "freq rebalance_date:d",
    " UNION ALL ".join(
        f"SELECT '{f}' AS freq, max(date) AS rebalance_date FROM sessions GROUP BY date_trunc('{u}', date)"
        for f, u in (("quarterly", "quarter"), ("monthly", "month"), ("annual", "year"))
    ),
)
def _(t: Inputs):
    out = None
    for freq in ("quarterly", "monthly", "annual"):
        part = calendar.rebalance_dates(t.sessions, freq).withColumn("freq", F.lit(freq))
        out = part if out is None else out.unionByName(part)
    return out


# -- as-of reads -------------------------------------------------------------------------

AS_OF = "1999-06-30"
FLOWS = asof.Dataset("participant_flows", entity="participant", lag_sessions=1)
PRICES_SET = asof.Dataset("prices", lag_sessions=0)
HOLDERS = asof.Dataset("shareholding", lag_days=21)


@query(
    "p1_available_from",
    "dataset date participant available_from:d",
    """SELECT 'sessions' AS dataset, f.date, participant, coalesce((SELECT min(s.date) FROM sessions s WHERE s.date > f.date), f.date + 1) AS available_from FROM flows f
       UNION ALL SELECT 'days', date, participant, date + 21 FROM flows""",
)
def _(t: Inputs):
    traded = asof.available_from(t.flows, t.sessions, FLOWS).withColumn("dataset", F.lit("sessions"))
    dated = asof.available_from(t.flows, t.sessions, HOLDERS).withColumn("dataset", F.lit("days"))
    cols = ["dataset", "date", "participant", "available_from"]
    return traded.select(*cols).unionByName(dated.select(*cols))


@query(
    "p2_cutoff",
    "as_of:d cutoff:d",
    f"SELECT day AS as_of, (SELECT s.date FROM sessions s WHERE s.pos = (SELECT max(pos) FROM sessions WHERE date <= day) - 1) AS cutoff FROM {ORDER_DAYS}",
)
def _(t: Inputs):
    return asof.cutoffs(_days(t, "orders", "o_orderdate").withColumnRenamed("day", "as_of"), t.sessions, FLOWS)


@query(
    "p3_snapshot",
    "date symbol close",
    f"SELECT date, symbol, close FROM px WHERE date <= DATE '{AS_OF}'",
)
def _(t: Inputs):
    return asof.snapshot(t.px, t.sessions, PRICES_SET, AS_OF, fields=["close"])


@query(
    "p4_lookback",
    "date participant net_futures:2",
    f"""SELECT date, participant, net_futures FROM flows WHERE date IN (SELECT date FROM sessions WHERE pos BETWEEN
         (SELECT max(pos) FROM sessions WHERE date <= DATE '{AS_OF}') - 12 AND (SELECT max(pos) FROM sessions WHERE date <= DATE '{AS_OF}') - 1)""",
)
def _(t: Inputs):
    return asof.snapshot(t.flows, t.sessions, FLOWS, AS_OF, lookback=12)


@query(
    "p5_entity_filter",
    "date symbol close volume",
    f"SELECT date, symbol, close, volume FROM px WHERE date <= DATE '{AS_OF}' AND symbol IN (SELECT symbol FROM sectors WHERE sector = 'ASIA')",
)
def _(t: Inputs):
    asia = t.sectors.filter("sector = 'ASIA'").select("symbol")
    return asof.snapshot(t.px, t.sessions, PRICES_SET, AS_OF, symbols=asia)


@query(
    "p6_projection",
    "symbol date volume turnover",
    f"SELECT symbol, date, volume, turnover FROM px WHERE date <= DATE '{AS_OF}'",
)
def _(t: Inputs):
    return asof.snapshot(t.px, t.sessions, PRICES_SET, AS_OF, fields=["volume", "turnover"])


@query(
    "p7_bulk_as_of",
    "as_of:d symbol date close",
    """SELECT as_of, symbol, date, close FROM (
         SELECT q.as_of, p.symbol, p.date, p.close, row_number() OVER (PARTITION BY q.as_of, p.symbol ORDER BY p.date DESC) AS rn
         FROM (SELECT max(date) AS as_of FROM sessions GROUP BY date_trunc('quarter', date)) q
         JOIN px p ON coalesce((SELECT min(s.date) FROM sessions s WHERE s.date > p.date), p.date + 1) <= q.as_of) WHERE rn = 1""",
)
def _(t: Inputs):
    queries = calendar.rebalance_dates(t.sessions).withColumnRenamed("rebalance_date", "as_of")
    lagged = asof.Dataset("lagged_prices", lag_sessions=1)
    return asof.latest_by_entity(t.px.select("date", "symbol", "close"), t.sessions, lagged, queries)


# -- windows -----------------------------------------------------------------------------


@query(
    "r1_row_returns",
    "date symbol ret:9",
    "SELECT date, symbol, adj_close / lag(adj_close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret FROM px",
)
def _(t: Inputs):
    return windows.row_returns(t.px)


def _grid(t: Inputs):
    return factors.factor_grid(t.px, t.sessions)


@query("r2_grid_returns", "symbol pos:i ret:9", "SELECT * FROM gret WHERE ret IS NOT NULL")
def _(t: Inputs):
    return _grid(t).filter(F.col("ret").isNotNull())


@query(
    "r3_rolling",
    "symbol pos:i mean8:6 sum8:4 std12:9",
    """SELECT * FROM (SELECT symbol, pos, CASE WHEN count(volume) OVER w8 >= 8 AND pos >= 7 THEN avg(volume) OVER w8 END AS mean8,
         CASE WHEN count(volume) OVER w8 >= 4 AND pos >= 7 THEN sum(volume) OVER w8 END AS sum8,
         CASE WHEN count(ret) OVER w12 >= 7 AND pos >= 11 THEN stddev_samp(ret) OVER w12 END AS std12 FROM gret
       WINDOW w8 AS (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 7 PRECEDING AND CURRENT ROW),
              w12 AS (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
       WHERE coalesce(mean8, sum8, std12) IS NOT NULL""",
)
def _(t: Inputs):
    out = _grid(t).select(
        "symbol", "pos",
        windows.rolling("volume", 8, "mean").alias("mean8"),
        windows.rolling("volume", 8, "sum", 4).alias("sum8"),
        windows.rolling("ret", 12, "std", windows.partial_need(12)).alias("std12"),
    )
    return out.filter(F.coalesce("mean8", "sum8", "std12").isNotNull())


@query(
    "r4_shift_sessions",
    "symbol pos:i past",
    "SELECT * FROM (SELECT symbol, pos, lag(adj_close, 4) OVER (PARTITION BY symbol ORDER BY pos) AS past FROM grid) WHERE past IS NOT NULL",
)
def _(t: Inputs):
    return _grid(t).select("symbol", "pos", windows.shifted("adj_close", 4).alias("past")).filter(F.col("past").isNotNull())


def _flow_days(t: Inputs):
    return flowfeatures.aligned_series(t.flows, t.sessions).withColumn("daily", windows.shifted("value", 1, ("series",)))


@query("r5_trailing_sum", "series pos:i flow:2", "ff")
def _(t: Inputs):
    return _flow_days(t).withColumn("flow", windows.trailing_sum("daily", REGIME.window, ("series",)))


@query("r6_shift_one", "series pos:i daily:2", "fu")
def _(t: Inputs):
    return _flow_days(t)


def _labelled(t: Inputs):
    flow = _flow_days(t).withColumn("flow", windows.trailing_sum("daily", REGIME.window, ("series",)))
    return windows.expanding_counts(flow, ("series",), "flow").withColumn(
        "regime", windows.expanding_bucket("flow", 3, REGIME.min_obs)
    )


@query("r7_expanding_bucket", "series pos:i regime", "flab")
def _(t: Inputs):
    return _labelled(t)


@query("r8_expanding_flag", "series pos:i shock", "flab")
def _(t: Inputs):
    sized = _flow_days(t).withColumn("size", F.abs("daily"))
    return windows.expanding_counts(sized, ("series",), "size").withColumn(
        "shock", windows.expanding_flag("size", REGIME.shock_percentile, REGIME.min_obs)
    )


@query("r9_divergence", "date flow_divergence", "feat")
def _(t: Inputs):
    return t.features


@query("r10_collapse_extreme", "date retail_regime retail_extreme", "feat")
def _(t: Inputs):
    return t.features


@query("r11_average_daily_value", "symbol date adv:5", "SELECT m.symbol, s.date, adv FROM mkt m JOIN sessions s USING (pos) JOIN px p ON p.symbol = m.symbol AND p.date = s.date")
def _(t: Inputs):
    return windows.average_daily_value(t.px, COSTS.adv_window)


@query(
    "r12_delta",
    "symbol pos:i change",
    "SELECT * FROM (SELECT symbol, pos, adj_close - lag(adj_close, 5) OVER (PARTITION BY symbol ORDER BY pos) AS change FROM grid) WHERE change IS NOT NULL",
)
def _(t: Inputs):
    return _grid(t).select("symbol", "pos", windows.delta("adj_close", 5).alias("change")).filter(F.col("change").isNotNull())


TSRANK = """SELECT symbol, pos, {v} AS x, list({v}) OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN {w} PRECEDING AND CURRENT ROW) AS h FROM {src}"""


@query(
    "r13_trailing_rank",
    "symbol pos:i rank:9",
    f"""SELECT symbol, pos, len(list_filter(h, lambda y: y < x)) / (len(list_filter(h, lambda y: y IS NOT NULL)) - 1)::DOUBLE - 0.5 AS rank
        FROM ({TSRANK.format(v='adj_close', w=9, src='grid')}) WHERE x IS NOT NULL AND pos >= 9 AND len(list_filter(h, lambda y: y IS NOT NULL)) > 1""",
)
def _(t: Inputs):
    ranked = windows.with_trailing_rank(_grid(t), "adj_close", 10, "rank").select("symbol", "pos", "rank")
    return ranked.filter(F.col("rank").isNotNull())


FEATURES = "date pos:i fii_flow:2 dii_flow:2 retail_flow:2 fii_daily:2 retail_daily:2 fii_regime retail_regime retail_extreme flow_divergence flow_shock"


@query("r14_flow_features", FEATURES, "feat")
def _(t: Inputs):
    return flowfeatures.flow_features(t.flows, t.sessions, REGIME)


@query(
    "r15_regime_coverage",
    "regime_column regime n:i first_defined:d last_defined:d",
    "SELECT regime_column, regime, count(*) AS n, min(date) AS first_defined, max(date) AS last_defined FROM lbl GROUP BY 1, 2",
)
def _(t: Inputs):
    return flowfeatures.regime_coverage(t.features)


# -- factors -----------------------------------------------------------------------------


def _one_factor(name: str, source: str, make, digits: int = 9):
    @query(name, f"date symbol value:{digits}", f"SELECT date, symbol, {source} AS value FROM fac WHERE {source} IS NOT NULL")
    def _(t: Inputs):
        return factors.factor_long(t.px, t.sessions, [make()])


_one_factor("f1_momentum", "momentum", lambda: factors.Momentum(26, 4))
_one_factor("f2_reversal", "reversal_4d", lambda: factors.Reversal(4))
_one_factor("f3_low_volatility", "low_volatility", lambda: factors.LowVolatility(12))
_one_factor("f4_illiquidity", "illiquidity", lambda: factors.Illiquidity(8), 4)
_one_factor("f5_delivery_ratio", "delivery_ratio", lambda: factors.DeliveryRatio(8))
_one_factor("f7_volume_trend", "volume_trend", lambda: factors.VolumeTrend(8))


@query(
    "f6_size",
    "date symbol value:9",
    "SELECT date, symbol, ln(close * shares) AS value FROM px JOIN shares USING (symbol) WHERE close * shares > 0",
)
def _(t: Inputs):
    return factors.factor_long(t.px, t.sessions, [factors.Size(True)], shares=t.shares)


@query("f8_factor_panel", "factor date symbol value:6", "panel")
def _(t: Inputs):
    return factors.build_panels(t.px, t.sessions, t.library, FACTORS)


@query(
    "f8_skipped_factors",
    "factor reason",
    "SELECT * FROM (VALUES ('no_history', 'insufficient history'), ('no_delivery', 'no usable data')) v(factor, reason) WHERE (SELECT count(*) FROM px) > 0",
)
def _(t: Inputs):
    long = factors.Momentum(4000, 4, "no_history")
    bare = factors.DeliveryRatio(8)
    bare.name = "no_delivery"
    blank = t.px.withColumn("delivery_pct", F.lit(None).cast("double"))
    return factors.skipped_factors(blank, t.sessions, [*t.library[:1], long, bare])


class RangePosition(factors.Factor):
    """User-defined example: where the close sits inside its trailing range."""

    name = "range_position"
    requires = ("adj_close",)
    history = 8
    reach = 8

    def windows(self):
        frame = windows.by_session("symbol").rangeBetween(-7, 0)
        return {"range_low": F.min("adj_close").over(frame), "range_high": F.max("adj_close").over(frame)}

    def value(self):
        span = F.col("range_high") - F.col("range_low")
        return finite(F.try_divide(F.col("adj_close") - F.col("range_low"), F.when(span > 0, span)))


@query(
    "f9_user_factor",
    "date symbol value:9",
    """SELECT * FROM (SELECT date, symbol, CASE WHEN max(adj_close) OVER w > min(adj_close) OVER w
         THEN (adj_close - min(adj_close) OVER w) / (max(adj_close) OVER w - min(adj_close) OVER w) END AS value FROM grid
         WINDOW w AS (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)) WHERE value IS NOT NULL""",
)
def _(t: Inputs):
    return factors.factor_long(t.px, t.sessions, [RangePosition()])


# -- cross-sections ----------------------------------------------------------------------


def _volumes(t: Inputs):
    return t.px.select("date", "symbol", F.col("volume").alias("value"))


oracle.part("vol", "SELECT date, symbol, volume AS value FROM px")


@query(
    "x1_winsorize",
    "date symbol value:6",
    """SELECT date, symbol, least(greatest(value, lo), hi) AS value FROM vol JOIN (SELECT date, quantile_cont(value, 0.05::DOUBLE) AS lo,
         quantile_cont(value, 0.95::DOUBLE) AS hi FROM vol GROUP BY 1) USING (date)""",
)
def _(t: Inputs):
    return xs.winsorize(_volumes(t), 0.05, 0.95)


@query(
    "x2_zscore",
    "date symbol value:6",
    """SELECT date, symbol, CASE WHEN n >= 2 AND s > 1e-12 * m THEN (value - a) / s END AS value FROM vol JOIN
         (SELECT date, avg(value) AS a, stddev_samp(value) AS s, count(*) AS n, max(abs(value)) AS m FROM vol GROUP BY 1) USING (date)""",
)
def _(t: Inputs):
    return xs.zscore(_volumes(t))


@query(
    "x3_sector_neutralize",
    "date symbol value:6",
    "SELECT date, symbol, value - avg(value) OVER (PARTITION BY date, coalesce(sector, 'NA')) AS value FROM vol LEFT JOIN sectors USING (symbol)",
)
def _(t: Inputs):
    return xs.neutralize(_volumes(t), t.sectors)


oracle.part("volt", oracle.treated("vol", "date"))


@query(
    "x4_treatment",
    "date symbol value:6",
    """SELECT date, symbol, CASE WHEN count(v) OVER d >= 2 AND stddev_samp(v) OVER d > 1e-12 * max(abs(v)) OVER d
         THEN (v - avg(v) OVER d) / stddev_samp(v) OVER d END AS value FROM (
       SELECT date, symbol, value - avg(value) OVER (PARTITION BY date, coalesce(sector, 'NA')) AS v FROM volt LEFT JOIN sectors USING (symbol))
       WINDOW d AS (PARTITION BY date)""",
)
def _(t: Inputs):
    return xs.treat(_volumes(t), neutral=True, mapping=t.sectors)


@query(
    "x5_scaled_rank",
    "date symbol value:9",
    """SELECT date, symbol, CASE WHEN n > 1 THEN (rn - 1) / (n - 1)::DOUBLE - 0.5 END AS value FROM (SELECT *, row_number() OVER
         (PARTITION BY date ORDER BY value, symbol) AS rn, count(*) OVER (PARTITION BY date) AS n FROM vol)""",
)
def _(t: Inputs):
    return xs.scaled_rank(_volumes(t), tie_code=tables.symbol_code())


@query(
    "x6_population_zscore",
    "date symbol value:6",
    """SELECT date, symbol, CASE WHEN stddev_pop(value) OVER d > 1e-12 THEN (value - avg(value) OVER d) / stddev_pop(value) OVER d END AS value
       FROM vol WINDOW d AS (PARTITION BY date)""",
)
def _(t: Inputs):
    return xs.population_zscore(_volumes(t))


@query(
    "x7_quintile_weights",
    "date symbol weight:9",
    """SELECT date, symbol, CASE WHEN rn <= k THEN -0.5 / k ELSE 0.5 / k END AS weight FROM (SELECT *, greatest(1, n // 5)::DOUBLE AS k FROM (
         SELECT *, row_number() OVER (PARTITION BY date ORDER BY value, symbol) AS rn, count(*) OVER (PARTITION BY date) AS n FROM vol))
       WHERE n >= 5 AND (rn <= k OR rn > n - k)""",
)
def _(t: Inputs):
    return xs.tail_weights(_volumes(t), tie_code=tables.symbol_code())


