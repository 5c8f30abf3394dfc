"""Registered queries: formula vocabulary, validity, evaluation, scoring and selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import factors, formula, regimes
from ..operators.columnar import rank_ic_columns, treat_columns, treated_long
from ..operators.labels import forward_return
from ..operators.panel import with_dates
from ..operators.sharpe import trial_summary
from ..session import stage
from ..sources import tables
from . import oracle
from .catalog import FACTORS, MIN_NAMES, Inputs, query

#: Formulas of the evaluation queries, in reverse Polish notation.
FORMULAS = (
    ("returns", "neg"),
    ("close", "delta5", "close", "div"),
    ("volume", "mean10", "log"),
    ("close", "mean5", "close", "div", "rank"),
    ("returns", "std10", "zscore", "neg"),
    ("turnover", "rank", "mean5"),
    ("close", "tsrank10", "returns", "mul"),
    ("returns", "fii_flow", "sign", "mul", "delay5"),
)

VOCABULARY = formula.arities()
_NAMES = list(VOCABULARY)


def _values(rows, names: str) -> str:
    return f"(VALUES {', '.join(str(r) for r in rows)}) v({names})"


ARITY_ROWS = [(n, a) for n, a in VOCABULARY.items()]


# Token sequences of every part: a digit walk through the vocabulary, legal or not.
WALK = ("(p_partkey * 7) % 9", "9 + (p_partkey * 5) % 6", "(p_partkey * 11 + p_size) % {n}", "(p_size * 13) % {n}", "{b} + p_partkey % 4")
oracle.part("cand", f"""
SELECT p_partkey, list_slice([{', '.join(f"voc[({w.format(n=len(_NAMES), b=len(_NAMES) - 4)})::BIGINT + 1]" for w in WALK)}], 1, (2 + p_partkey % 4)::BIGINT) AS tokens
FROM part CROSS JOIN (SELECT [{', '.join(repr(n) for n in _NAMES)}] AS voc)
""")


def _candidates(t: Inputs) -> DataFrame:
    words = F.array(*[F.lit(n) for n in _NAMES])
    picks = F.array(
        *[F.get(words, F.expr(w.format(n=len(_NAMES), b=len(_NAMES) - 4)).cast("int")) for w in WALK]
    )
    return t.table("part").select("p_partkey", F.slice(picks, 1, (2 + F.col("p_partkey") % 4).cast("int")).alias("tokens"))


@query(
    "m1_vocabulary",
    "token arity:i n_used:i",
    f"""SELECT token, arity, count(p_partkey) AS n_used FROM {_values(ARITY_ROWS, 'token, arity')}
        LEFT JOIN (SELECT p_partkey, unnest(tokens) AS token FROM cand) USING (token) GROUP BY 1, 2""",
)
def _(t: Inputs):
    used = _candidates(t).select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    table = t.spark.createDataFrame(list(VOCABULARY.items()), "token string, arity int")
    return table.join(used, "token", "left").withColumn("n_used", F.coalesce("n", F.lit(0)))


oracle.part("depths", f"""
SELECT p_partkey, i, len(tokens) AS k, sum(1 - a) OVER (PARTITION BY p_partkey ORDER BY i) AS depth
FROM (SELECT p_partkey, tokens, unnest(range(1, len(tokens) + 1)) AS i FROM cand) x
JOIN {_values(ARITY_ROWS, 'token, a')} ON token = tokens[i]
""")


@query(
    "m4_formula_validity",
    "p_partkey:i complete",
    "SELECT p_partkey, bool_and(depth >= 1 OR i = k) AND bool_or(i = k AND depth = 1) AS complete FROM depths GROUP BY 1",
)
def _(t: Inputs):
    return _candidates(t).withColumn("complete", formula.is_complete(F.col("tokens"), VOCABULARY))


@query(
    "m4_infix_text",
    "p_partkey:i text",
    f"""SELECT p_partkey, text FROM (WITH RECURSIVE st AS (
         SELECT p_partkey, tokens, 0 AS i, []::VARCHAR[] AS stack, true AS ok FROM cand
         UNION ALL
         SELECT p_partkey, tokens, i + 1, CASE WHEN NOT fits THEN stack WHEN arity = 0 THEN list_append(stack, tok)
             WHEN arity = 1 THEN list_append(stack[1 : len(stack) - 1], tok || '(' || stack[len(stack)] || ')')
             ELSE list_append(stack[1 : len(stack) - 2], tok || '(' || stack[len(stack) - 1] || ', ' || stack[len(stack)] || ')') END, ok AND fits
         FROM (SELECT s.*, a.token AS tok, a.arity, len(s.stack) >= a.arity AS fits
               FROM st s JOIN {_values(ARITY_ROWS, 'token, arity').replace(' v(', ' a(')} ON a.token = s.tokens[s.i + 1] WHERE s.i < len(s.tokens)))
       SELECT p_partkey, CASE WHEN ok AND len(stack) > 0 THEN stack[len(stack)] ELSE array_to_string(tokens, ' ') END AS text FROM st WHERE i = len(tokens))""",
)
def _(t: Inputs):
    return _candidates(t).withColumn("text", formula.infix(F.col("tokens"), VOCABULARY))


# -- evaluation --------------------------------------------------------------------------


def _base(t: Inputs, horizon: int | None = None) -> DataFrame:
    """The terminals; with ``horizon``, the label next to them as ``_label``."""
    grid = factors.factor_grid(t.px, t.sessions)
    if horizon is None:
        return formula.terminals(grid, t.features)
    return formula.terminals(grid.withColumn("_label", forward_return(horizon)), t.features, keep=("_label",))


oracle.part("tm", """
SELECT g.date, g.pos, g.symbol, g.adj_close AS close, g.volume, g.turnover, g.ret AS returns, f.fii_flow, f.dii_flow, f.retail_flow, f.fii_daily,
  f.flow_shock::INT::DOUBLE AS flow_shock_num FROM gret g LEFT JOIN feat f ON f.pos = g.pos
""")


@query(
    "m2_terminals",
    "pos:i n_close:i n_returns:i fii_flow:2 dii_flow:2 retail_flow:2 fii_daily:2 flow_shock_num:1",
    """SELECT pos, count(close) AS n_close, count(returns) AS n_returns, max(fii_flow) AS fii_flow, max(dii_flow) AS dii_flow,
         max(retail_flow) AS retail_flow, max(fii_daily) AS fii_daily, max(flow_shock_num) AS flow_shock_num FROM tm GROUP BY 1""",
)
def _(t: Inputs):
    return _base(t).groupBy("pos").agg(
        F.count("close").alias("n_close"),
        F.count("returns").alias("n_returns"),
        *[F.max(c).alias(c) for c in formula.FLOW_TERMINALS],
    )


def _w(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _guard(x: str, n: int, agg: str) -> str:
    return f"CASE WHEN count({x}) OVER {_w(n)} >= {max(2, int(0.6 * n))} AND pos >= {n - 1} THEN {agg}({x}) OVER {_w(n)} END"


def _tsrank(x: str, n: int) -> str:
    h = f"list({x}) OVER {_w(n)}"
    return (f"CASE WHEN {x} IS NOT NULL AND pos >= {n - 1} AND len(list_filter({h}, lambda y: y IS NOT NULL)) > 1 THEN "
            f"len(list_filter({h}, lambda y: y < {x})) / (len(list_filter({h}, lambda y: y IS NOT NULL)) - 1)::DOUBLE - 0.5 END")


def _cross_rank(x: str) -> str:
    part = f"PARTITION BY pos, {x} IS NULL"
    return (f"CASE WHEN {x} IS NOT NULL AND count(*) OVER ({part}) > 1 THEN (row_number() OVER ({part} ORDER BY {x}, symbol) - 1) / "
            f"(count(*) OVER ({part}) - 1)::DOUBLE - 0.5 END")


oracle.part("fm0", f"""
SELECT pos, symbol, -returns AS c0, (close - lag(close, 5) OVER (PARTITION BY symbol ORDER BY pos)) / close AS c1,
  CASE WHEN {_guard('volume', 10, 'avg')} > 0 THEN ln({_guard('volume', 10, 'avg')}) END AS c2, {_guard('close', 5, 'avg')} / close AS a3,
  {_guard('returns', 10, 'stddev_samp')} AS a4, {_cross_rank('turnover')} AS a5, ({_tsrank('close', 10)}) * returns AS c6,
  lag(returns * sign(fii_flow), 5) OVER (PARTITION BY symbol ORDER BY pos) AS c7 FROM tm
""")
oracle.part("fm1", f"""
SELECT pos, symbol, c0, c1, c2, {_cross_rank('a3')} AS c3,
  CASE WHEN stddev_pop(a4) OVER (PARTITION BY pos) > 1e-12 THEN -((a4 - avg(a4) OVER (PARTITION BY pos)) / stddev_pop(a4) OVER (PARTITION BY pos)) END AS c4,
  {_guard('a5', 5, 'avg')} AS c5, c6, c7 FROM fm0
""")
oracle.part("fml", " UNION ALL ".join(
    f"SELECT {i} AS candidate, s.date, f.pos, f.symbol, c{i} AS value FROM fm1 f JOIN sessions s USING (pos) WHERE c{i} IS NOT NULL" for i in range(len(FORMULAS))
))


def _signals(t: Inputs) -> DataFrame:
    return formula.evaluate(_base(t), FORMULAS, tie_code=tables.symbol_code())


@query("m3_formula_values", "candidate:i pos:i symbol value:7", "fml")
def _(t: Inputs):
    return _signals(t)


oracle.part("fmt", oracle.treated("fml", "candidate, date"))


def _treated(t: Inputs, horizon: int | None = None) -> list[tuple[DataFrame, dict[int, tuple[str, str]]]]:
    """Wide frames with each candidate's raw and treated column, and the label if a horizon is given."""
    keep = () if horizon is None else ("_label",)
    parts = formula.evaluate_columns(_base(t, horizon), FORMULAS, tie_code=tables.symbol_code(), keep=keep)
    out = []
    for at, (df, columns) in enumerate(parts, 1):
        held = df if at < len(parts) else stage(df, "signals")
        wide, names = treat_columns(with_dates(held, t.sessions), list(columns.values()), winsor=FACTORS.winsor)
        out.append((wide, {i: (c, names[c]) for i, c in columns.items()}))
    return out


@query("m5_standardised_signals", "candidate:i date symbol value:6", "fmt")
def _(t: Inputs):
    return reduce(DataFrame.unionByName, [treated_long(df, c, "candidate", ["date", "symbol"]) for df, c in _treated(t)])


oracle.part("lab4", "SELECT date, symbol, ret FROM labl WHERE horizon = 4")
oracle.part("fic", oracle.rank_ic("fmt", "lab4", "a.candidate, a.date", "candidate, date"))
oracle.part("frw", """
SELECT candidate, count(*) AS n_rows, avg(ic) AS mean_ic, CASE WHEN count(*) >= 60 THEN avg(ic) END AS pooled FROM fic GROUP BY 1
""")
oracle.part("frb", """
SELECT candidate, min(m) AS worst FROM (SELECT candidate, regime, avg(ic) AS m FROM fic JOIN (SELECT date, regime FROM lbl WHERE regime_column = 'fii_regime') USING (date)
GROUP BY 1, 2 HAVING count(*) >= 20) GROUP BY 1
""")


def _candidate_ic(t: Inputs) -> DataFrame:
    found = [
        rank_ic_columns(df, {i: c for i, (_, c) in names.items()}, {4: "_label"}, series=("candidate", "horizon"), min_names=MIN_NAMES)
        for df, names in _treated(t, 4)
    ]
    return stage(reduce(DataFrame.unionByName, found).drop("horizon"), "ic")


def _rewards(t: Inputs, ic: DataFrame) -> DataFrame:
    totals = ic.groupBy("candidate").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("ic").alias("mean_ic"))
    return formula.rewards(totals)


@query(
    "m6_rewards",
    "candidate:i n_rows:i mean_ic:9 reward:9 worst_bucket:9",
    "SELECT candidate, n_rows, mean_ic, pooled AS reward, CASE WHEN n_rows >= 60 THEN worst END AS worst_bucket FROM frw LEFT JOIN frb USING (candidate)",
)
def _(t: Inputs):
    ic = _candidate_ic(t)
    by_bucket = regimes.attach(ic, t.labels, "fii_regime").groupBy("candidate", "regime").agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg("ic").alias("mean_ic")
    )
    pooled = _rewards(t, ic)
    robust = formula.rewards(pooled.drop("reward"), by_bucket).select("candidate", F.col("reward").alias("worst_bucket"))
    return pooled.join(robust, "candidate")


def _sql_list(tokens) -> str:
    return "[" + ", ".join(f"'{x}'" for x in tokens) + "]"


oracle.part("ftok", f"SELECT * FROM (VALUES {', '.join(f'({i}, {_sql_list(f)})' for i, f in enumerate(FORMULAS))}) v(candidate, tokens)")


@query(
    "m7_novelty_penalty",
    "p_partkey:i penalty:9",
    """SELECT p_partkey, max(0.2::DOUBLE * len(list_intersect(list_distinct(c.tokens), list_distinct(f.tokens))) /
         len(list_distinct(list_concat(c.tokens, f.tokens)))) AS penalty FROM cand c CROSS JOIN ftok f GROUP BY 1""",
)
def _(t: Inputs):
    mine = _candidates(t).withColumnRenamed("p_partkey", "candidate")
    return formula.novelty_penalty(mine, _tokens(t)).withColumnRenamed("candidate", "p_partkey")


def _tokens(t: Inputs) -> DataFrame:
    return t.spark.createDataFrame([(i, list(f)) for i, f in enumerate(FORMULAS)], "candidate int, tokens array<string>")


#: Formulas of the first batch; the later ones are penalised for resembling what it kept.
FIRST_BATCH, TOP = 4, 4


def _kept(t: Inputs) -> DataFrame:
    scored = stage(_rewards(t, _candidate_ic(t)).join(_tokens(t), "candidate"), "scored")
    first = formula.keep_best(scored.filter(F.col("candidate") < FIRST_BATCH), TOP)
    return formula.keep_best(scored.filter(F.col("candidate") >= FIRST_BATCH), TOP, stage(first, "kept"))


BEST = "ORDER BY reward DESC, len(tokens), candidate LIMIT 4"
oracle.part("fsc", "SELECT candidate, n_rows, pooled AS reward, tokens FROM frw JOIN ftok USING (candidate) WHERE pooled IS NOT NULL")
oracle.part("fk1", f"SELECT * FROM fsc WHERE candidate < 4 {BEST}")
oracle.part("fk2", f"""
SELECT * FROM (SELECT * FROM fk1 UNION ALL SELECT c.candidate, c.n_rows, c.reward - coalesce(max(0.2::DOUBLE * len(list_intersect(list_distinct(c.tokens), list_distinct(f.tokens))) /
  len(list_distinct(list_concat(c.tokens, f.tokens)))), 0), c.tokens FROM fsc c LEFT JOIN fk1 f ON true WHERE c.candidate >= 4 GROUP BY c.candidate, c.n_rows, c.reward, c.tokens) {BEST}
""")


@query("m8_keep_best", "candidate:i reward:9 n_rows:i", "SELECT candidate, reward, n_rows FROM fk2")
def _(t: Inputs):
    return _kept(t)


@query("m10_register_trials", "name kind count:i", "SELECT 'mined:' || array_to_string(tokens, ' ') AS name, 'mined' AS kind, 1 AS count FROM fk2")
def _(t: Inputs):
    return trial_summary(formula.trial_rows(_kept(t), F.lit("2024-01-01T00:00:00")))
