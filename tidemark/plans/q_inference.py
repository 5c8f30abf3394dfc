"""Registered queries: labels, ICs, regimes, splits, Sharpe ratios and overfitting."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import functions as F

from ..functions.numeric import expected_max_normal, normal_cdf
from ..functions.paths import MAX_DRAWDOWN, SORTINO
from ..operators import inference, labels, regimes, sharpe, splits
from ..operators.factors import Reversal
from ..session import stage
from ..sources import tables
from . import oracle, studies
from .catalog import BOOK, COMPOSITE, FACTORS, HORIZONS, MIN_NAMES, REGIME, Inputs, query
from .oracle import phi


# -- labels and ICs ----------------------------------------------------------------------


@query("i1_forward_returns", "date symbol fwd_1:9 fwd_4:9 fwd_12:9", "lab")
def _(t: Inputs):
    return labels.forward_returns(t.px, t.sessions, HORIZONS)


@query("i2_rank_ic", "factor horizon:i date ic:9 n:i", "ic")
def _(t: Inputs):
    return studies.ic_series(t.study, MIN_NAMES)


@query(
    "i3_newey_west",
    "factor horizon:i n:i mean:9 se:9 nw_lags:i",
    f"SELECT * FROM ({oracle.newey_west('ic', 'factor, horizon', 'ic', 'date', oracle.AUTO)})",
)
def _(t: Inputs):
    return inference.mean_errors(t.ic, ["factor", "horizon"], "ic", "date")


IC_TABLE = "n_dates:i mean_ic:9 std_ic:9 ic_ir:8 t_stat:6 nw_lags:i hit_rate:9 mean_names:6"


@query(
    "i4_ic_summary",
    f"factor {IC_TABLE}",
    "SELECT * FROM ictab WHERE factor = 'reversal_4d' AND horizon = 1",
)
def _(t: Inputs):
    study = studies.prepare(t.px, t.sessions, [Reversal(4)], FACTORS, [1])
    return inference.summarize_ic(stage(studies.ic_series(study, MIN_NAMES), "ic"), ["factor"], F.lit(1))


@query("i5_ic_table", f"factor horizon:i {IC_TABLE} deflated", "SELECT *, false AS deflated FROM ictab")
def _(t: Inputs):
    return studies.ic_table(t.study, MIN_NAMES)


@query(
    "i6_usable_from",
    "factor date ic:9 usable_from:d",
    "SELECT i.factor, i.date, i.ic, u.date AS usable_from FROM ic4 i JOIN sessions s ON s.date = i.date LEFT JOIN sessions u ON u.pos = s.pos + 4",
)
def _(t: Inputs):
    return labels.usable_from(t.ic4, t.sessions)


# -- regimes -----------------------------------------------------------------------------


@query(
    "i7_regime_attach",
    "factor date ic:9 regime",
    "SELECT * FROM cic WHERE regime_column = 'fii_regime'",
)
def _(t: Inputs):
    return regimes.attach(t.ic4, t.labels, "fii_regime")


@query("i8_regime_buckets", "regime_column regime", "SELECT DISTINCT regime_column, regime FROM lbl")
def _(t: Inputs):
    return regimes.buckets(t.labels)


CONDITIONAL = """SELECT a.factor, a.regime_column, a.regime, a.n AS n_dates, a.mean AS mean_ic, a.sd AS std_ic, a.mean / a.sd AS ic_ir,
  a.mean / a.se AS t_stat, a.nw_lags, b.hit_rate, b.mean_names
  FROM cicnw a JOIN (SELECT factor, regime_column, regime, avg((ic > 0)::INT::DOUBLE) AS hit_rate, avg(names) AS mean_names,
    count(*) AS c FROM cic GROUP BY 1, 2, 3) b USING (factor, regime_column, regime) WHERE b.c >= 30"""


@query("i9_conditional_ic", f"factor regime {IC_TABLE}", f"SELECT * FROM ({CONDITIONAL}) WHERE regime_column = 'fii_regime'")
def _(t: Inputs):
    one = t.labels.filter("regime_column = 'fii_regime'")
    return regimes.conditional_ic(t.ic4, one, ["factor"], F.lit(COMPOSITE.horizon))


@query("i10_conditional_table", f"factor regime_column regime {IC_TABLE}", CONDITIONAL)
def _(t: Inputs):
    return regimes.conditional_ic(t.ic4, t.labels, ["factor"], F.lit(COMPOSITE.horizon))


def _experiments(t: Inputs):
    return regimes.declared_experiments(t.ic4.select("factor").distinct(), t.labels, REGIME)


@query("i11_declared_experiments", "factor prefix regime_column favourable unfavourable", "fmap")
def _(t: Inputs):
    return _experiments(t)


oracle.part("verd", """
SELECT factor, regime_column, power_at_reference, CASE WHEN supported THEN 'SUPPORTED' WHEN t_stat IS NULL THEN 'INCONCLUSIVE (insufficient data)'
  WHEN difference < 0 AND abs(t_stat) >= 1.5 THEN 'REFUTED' WHEN power_at_reference < 0.8 THEN 'INCONCLUSIVE (underpowered)'
  ELSE 'NOT SUPPORTED' END AS verdict FROM exppw
""")


def _results(t: Inputs):
    return regimes.run_experiments(t.ic4, t.labels, _experiments(t), REGIME)


@query(
    "i12_experiments",
    "factor regime_column ic_favourable:9 ic_unfavourable:9 n_favourable:i n_unfavourable:i difference:9 se_difference:9 t_stat:6 supported",
    "expr",
)
def _(t: Inputs):
    return _results(t)


@query(
    "i13_power",
    "factor regime_column reference_effect:9 observed_difference:9 detectable_50:9 mde:9 mde_over_ic:6 power_at_reference:8 power_at_observed:8 adequate",
    "SELECT *, power_at_reference >= 0.8 AS adequate FROM exppw",
)
def _(t: Inputs):
    return regimes.with_power(_results(t), REGIME)


@query(
    "i14_verdict",
    "factor regime_column verdict",
    "SELECT factor, regime_column, verdict FROM verd",
)
def _(t: Inputs):
    return regimes.with_verdict(regimes.with_power(_results(t), REGIME), REGIME)


@query(
    "i15_conditional_panel",
    "factor date symbol value:6",
    """SELECT factor, p.date, symbol, CASE WHEN l.date IS NOT NULL THEN value ELSE 0 END AS value FROM panel p LEFT JOIN
         (SELECT date FROM lbl WHERE regime_column = 'fii_regime' AND regime IN ('high')) l ON l.date = p.date""",
)
def _(t: Inputs):
    return regimes.conditional_panel(t.study.panel, t.labels, "fii_regime", ["high"])


@query(
    "i16_regime_exposure",
    "exposure:9",
    "SELECT avg((regime = 'high')::INT::DOUBLE) AS exposure FROM lbl WHERE regime_column = 'fii_regime'",
)
def _(t: Inputs):
    return regimes.regime_exposure(t.labels, "fii_regime", ["high"])


oracle.part("cpan", """
SELECT f.factor || '|' || f.regime_column AS factor, p.date, p.pos, p.symbol, CASE WHEN l.date IS NOT NULL THEN value ELSE 0 END AS value
FROM fmap f JOIN panel p ON p.factor = f.factor LEFT JOIN lbl l ON l.date = p.date AND l.regime_column = f.regime_column AND l.regime = f.favourable
""")
oracle.part("ctails", f"SELECT *, 1.0::DOUBLE AS scale FROM ({oracle.PARTS['tails'].replace('FROM panel', 'FROM cpan')})")
oracle.part("cbk", oracle.book("ctails", "strategy"))
oracle.part("cdly", oracle.daily("cbk", "strategy"))
oracle.part("cboth", " UNION ALL ".join(oracle.sized(source, size) for source in ("cdly", "dly") for size in ("1e5", "1.0")))
oracle.part("csum", oracle.summary("cboth", "strategy, notional"))


@query(
    "i12_conditional_study",
    "factor regime_column verdict power_at_reference:8 exposure:9 net_conditional:7 net_unconditional:7 beats_net fixed_conditional:7 fixed_unconditional:7 beats_fixed",
    """SELECT v.factor, v.regime_column, v.verdict, v.power_at_reference, x.exposure, a.net_sharpe AS net_conditional, b.net_sharpe AS net_unconditional,
         coalesce(a.net_sharpe > b.net_sharpe, false) AS beats_net, c.net_sharpe AS fixed_conditional, d.net_sharpe AS fixed_unconditional, coalesce(c.net_sharpe > d.net_sharpe, false) AS beats_fixed
       FROM verd v JOIN (SELECT f.factor, f.regime_column, avg((l.regime = f.favourable)::INT::DOUBLE) AS exposure FROM fmap f JOIN lbl l USING (regime_column) GROUP BY 1, 2) x USING (factor, regime_column)
       LEFT JOIN csum a ON a.strategy = v.factor || '|' || v.regime_column AND a.notional = 1e5 LEFT JOIN csum b ON b.strategy = v.factor AND b.notional = 1e5
       LEFT JOIN csum c ON c.strategy = v.factor || '|' || v.regime_column AND c.notional = 1.0 LEFT JOIN csum d ON d.strategy = v.factor AND d.notional = 1.0""",
)
def _(t: Inputs):
    verdicts = regimes.with_verdict(regimes.with_power(_results(t), REGIME), REGIME)
    return studies.conditional_study(t.study, t.labels, _experiments(t), verdicts, BOOK, tie_code=tables.symbol_code())


# -- splits ------------------------------------------------------------------------------

oracle.part("nses", "SELECT count(*) AS n FROM sessions")
oracle.part("folds", """
SELECT fold, date, pos, CASE WHEN pos >= lo AND pos < hi THEN 'test' WHEN pos + 4 >= lo AND pos <= hi - 1 + 4 THEN 'purged'
    WHEN (pos >= lo - 5 AND pos < lo) OR (pos >= hi AND pos < hi + 5) THEN 'embargo' ELSE 'train' END AS role
FROM (SELECT f.range AS fold, s.date, s.pos, f.range * n // 6 AS lo, (f.range + 1) * n // 6 AS hi FROM range(6) f CROSS JOIN sessions s CROSS JOIN nses)
""")


def _folds(t: Inputs):
    return splits.purged_folds(t.sessions, n_splits=6, horizon=4, embargo=5)


@query("v1_purged_folds", "fold:i date role", "folds")
def _(t: Inputs):
    return _folds(t)


@query(
    "v1_fold_rows",
    "fold:i role n_rows:i volume",
    "SELECT fold, role, count(*) AS n_rows, sum(volume) AS volume FROM folds JOIN px USING (date) GROUP BY 1, 2",
)
def _(t: Inputs):
    roles = _folds(t).select("fold", "date", "role")
    return t.px.join(roles, "date").groupBy("fold", "role").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("volume").alias("volume")
    )


@query(
    "v2_leakage_check",
    "fold:i clean n_train:i",
    """SELECT a.fold, coalesce(bool_and(NOT (b.pos + 4 >= a.lo AND b.pos <= a.hi + 4)), true) AS clean, count(b.pos) AS n_train
       FROM (SELECT fold, min(pos) AS lo, max(pos) AS hi FROM folds WHERE role = 'test' GROUP BY 1) a
       LEFT JOIN folds b ON b.fold = a.fold AND b.role = 'train' GROUP BY 1""",
)
def _(t: Inputs):
    return splits.leakage_check(_folds(t), 4)


# -- Sharpe ratios -----------------------------------------------------------------------

oracle.part("shp", """
SELECT strategy, count(net_return) AS n_obs, avg(net_return) AS m, stddev_samp(net_return) AS s,
  avg(net_return) / stddev_samp(net_return) AS sharpe_period, avg(net_return) / stddev_samp(net_return) * sqrt(252) AS sharpe_annual,
  skewness(net_return) AS skew, kurtosis(net_return) AS kurtosis FROM dlyn GROUP BY 1
""")


@query("v3_sharpe", "strategy n_obs:i sharpe_period:9 sharpe_annual:8", "shp")
def _(t: Inputs):
    return sharpe.sharpe(t.daily, ["strategy"], "net_return")


EULER = 0.5772156649015329


def _emax(k: int) -> float:
    q, g = NormalDist().inv_cdf, EULER
    return (1 - g) * q(1 - 1 / k) + g * q(1 - 1 / (k * math.e))


def _emax_sql(column: str) -> str:
    """SQL has no inverse normal: the expected maximum of k draws as one CASE branch per k."""
    cases = " ".join(f"WHEN {k} THEN {_emax(k)!r}::DOUBLE" for k in range(2, 80))
    return f"(CASE {column} WHEN 1 THEN 0.0::DOUBLE {cases} END)"


def probit_sql(p: str) -> str:
    """The inverse normal above one half, by bisection on ``phi``: 60 halvings of [0, 8]."""
    return f"list_reduce(list_prepend(4.0::DOUBLE, range(1, 60)), lambda x, k: x + CASE WHEN {phi('x')} < {p} THEN 1 ELSE -1 END * 4.0::DOUBLE / pow(2, k))"


@query(
    "v4_expected_max_sharpe",
    "symbol n_trials:i expected_max:8",
    f"SELECT symbol, n_trials, {_emax_sql('n_trials')} AS expected_max FROM (SELECT symbol, 1 + count(*) // 10 AS n_trials FROM px GROUP BY 1)",
)
def _(t: Inputs):
    counts = t.px.groupBy("symbol").agg((1 + F.floor(F.count(F.lit(1)) / 10)).alias("n_trials"))
    return counts.withColumn("expected_max", expected_max_normal(F.col("n_trials").cast("long")))


PSR_Z = "({sr} - {bench}) / sqrt((1 - skew * {sr} + (kurtosis + 2.0) / 4.0 * {sr} * {sr}) / (n_obs - 1))"


@query(
    "v5_probabilistic_sharpe",
    "strategy z:6 psr:8",
    f"SELECT strategy, z, {phi('z')} AS psr FROM (SELECT strategy, {PSR_Z.format(sr='sharpe_period', bench='0.01::DOUBLE')} AS z FROM shp)",
)
def _(t: Inputs):
    rows = sharpe.deflation_inputs(t.daily, ["strategy"], "net_return")
    z = sharpe.psr_argument(F.col("sharpe_period"), F.lit(0.01), F.col("n_obs"), F.col("skew"), F.col("kurtosis"))
    return rows.withColumn("z", z).withColumn("psr", normal_cdf(F.col("z")))


oracle.part("dsr", f"""
SELECT *, {phi('z')} AS dsr FROM (SELECT *, {PSR_Z.format(sr='sharpe_period', bench='expected_max')} AS z FROM
  (SELECT *, emax * sqrt(1.0::DOUBLE / (n_obs - 1)) AS expected_max FROM shp CROSS JOIN
    (SELECT n_trials, {1 - EULER} * {probit_sql('p1')} + {EULER} * {probit_sql('p2')} AS emax FROM
      (SELECT count(*) AS n_trials, 1 - 1.0::DOUBLE / count(*) AS p1, 1 - 1.0::DOUBLE / (count(*) * exp(1)) AS p2 FROM events))))
""")


def trial_count(t: Inputs):
    """The trials of the log, as the deflation of every result needs them."""
    return sharpe.trial_totals(t.table("events").select(F.col("user_id").alias("name"))).select("n_trials").scalar()


@query("v6_deflated_sharpe", "strategy n_trials:i skew:7 kurtosis:7 expected_max:9 z:6 dsr:8", "dsr")
def _(t: Inputs):
    return sharpe.deflated_sharpe(t.daily, ["strategy"], "net_return", trial_count(t))


@query(
    "v7_trial_registry",
    "name kind count:i first_seen last_seen detail",
    """SELECT 'user' || user_id AS name, min_by(event_type, ts) AS kind, count(*) AS count, min(ts)::VARCHAR AS first_seen,
         max(ts)::VARCHAR AS last_seen, max_by(props, ts) FILTER (value > 20) AS detail FROM events GROUP BY user_id""",
)
def _(t: Inputs):
    log = t.table("events").select(
        F.concat(F.lit("user"), F.col("user_id")).alias("name"),
        F.col("event_type").alias("kind"),
        "ts",
        F.when(F.col("value") > 20, F.col("props")).alias("detail"),
    )
    out = sharpe.trial_summary(log)
    return out.withColumns({c: F.col(c).cast("string") for c in ("first_seen", "last_seen")})


@query("v7_trial_totals", "n_trials:i n_distinct:i", "SELECT count(*) AS n_trials, count(DISTINCT user_id) AS n_distinct FROM events")
def _(t: Inputs):
    log = t.table("events").select(F.col("user_id").alias("name"))
    return sharpe.trial_totals(log)


SPLITS = 16
oracle.part("pblk", f"""
SELECT strategy, ret, period, (SELECT max(k.range) FROM range({SPLITS}) k WHERE k.range * n // {SPLITS} <= period) AS block
FROM (SELECT strategy, net_return AS ret, row_number() OVER (PARTITION BY strategy ORDER BY pos) - 1 AS period, count(*) OVER (PARTITION BY strategy) AS n FROM dlyn)
""")
oracle.part("pmask", f"SELECT m.range AS mask FROM range({2 ** SPLITS}) m WHERE bit_count(m.range) = {SPLITS // 2}")
oracle.part("pside", """
SELECT mask, strategy, ((mask >> block) & 1) = 1 AS inside, avg(ret) / stddev_samp(ret) AS score
FROM pmask CROSS JOIN pblk GROUP BY 1, 2, 3
""")
oracle.part("plog", """
SELECT mask, best, n_configs, omega, ln(omega / (1 - omega)) AS logit FROM (
SELECT a.mask, a.strategy AS best, (SELECT count(*) FROM strategies) AS n_configs,
  (SELECT count(*) FILTER (b.score < c.score) + (count(*) FILTER (b.score = c.score) + 1) / 2.0::DOUBLE FROM pside b WHERE b.mask = a.mask AND NOT b.inside)
    / ((SELECT count(*) FROM strategies) + 1) AS omega
FROM (SELECT *, row_number() OVER (PARTITION BY mask ORDER BY score DESC, strategy) AS rn FROM pside WHERE inside) a
JOIN pside c ON c.mask = a.mask AND c.strategy = a.strategy AND NOT c.inside WHERE a.rn = 1)
""")


@query("v8_split_logits", "mask:i best n_configs:i omega:9 logit:8", "plog")
def _(t: Inputs):
    aligned = stage(sharpe.right_align(t.daily, "strategy", "net_return"), "aligned")
    return sharpe.split_logits(aligned, n_partitions=SPLITS)


@query(
    "v8_overfitting_probability",
    "pbo:9 n_splits:i n_configs:i median_oos_rank:9",
    "SELECT avg((omega <= 0.5)::INT::DOUBLE) AS pbo, count(*) AS n_splits, max(n_configs) AS n_configs, quantile_cont(omega, 0.5::DOUBLE) AS median_oos_rank FROM plog",
)
def _(t: Inputs):
    aligned = stage(sharpe.right_align(t.daily, "strategy", "net_return"), "aligned")
    return sharpe.overfitting_probability(sharpe.split_logits(aligned, n_partitions=SPLITS))


# The same splits ranked by metrics that Sharpe's moments do not give.
oracle.part("psort", """
SELECT mask, strategy, ((mask >> block) & 1) = 1 AS inside, avg(ret) / nullif(sqrt(avg(pow(least(ret, 0), 2))), 0) AS score
FROM pmask CROSS JOIN pblk GROUP BY 1, 2, 3
""")
oracle.part("pordered", """
SELECT mask, strategy, inside, pos, product(1 + ret) OVER (PARTITION BY mask, strategy, inside ORDER BY pos) AS eq
FROM (SELECT mask, strategy, ((mask >> block) & 1) = 1 AS inside, period AS pos, ret FROM pmask CROSS JOIN pblk)
""")
oracle.part("pfall", """
SELECT mask, strategy, inside, min(fall) AS score FROM (
SELECT *, eq / max(eq) OVER (PARTITION BY mask, strategy, inside ORDER BY pos) - 1 AS fall FROM pordered) GROUP BY 1, 2, 3
""")
for _name, _scores in (("sortino", "psort"), ("drawdown", "pfall")):
    oracle.part(f"plog_{_name}", oracle.PARTS["plog"].replace("pside", _scores))


@query(
    "v8_path_metrics",
    "metric mask:i best n_configs:i omega:9",
    "SELECT 'sortino' AS metric, mask, best, n_configs, omega FROM plog_sortino UNION ALL SELECT 'drawdown', mask, best, n_configs, omega FROM plog_drawdown",
)
def _(t: Inputs):
    aligned = stage(sharpe.right_align(t.daily, "strategy", "net_return"), "aligned")
    out = None
    for name, metric in (("sortino", SORTINO), ("drawdown", MAX_DRAWDOWN)):
        part = sharpe.split_logits(aligned, n_partitions=SPLITS, metric=metric).withColumn("metric", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
