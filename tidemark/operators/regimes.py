"""Regime-conditional inference: conditional ICs, declared experiments, power, verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RegimeConfig
from ..functions.numeric import (
    MAX_SESSIONS,
    broadcast_if_bounded,
    normal_cdf,
    normal_quantile,
    ratio,
)
from .flowfeatures import REGIME_COLUMNS
from .inference import mean_errors, summarize_ic

#: regime column -> (bucket expected to help, bucket expected to hurt)
DECLARED_SIDES = {"fii_regime": ("high", "low"), "retail_extreme": ("extreme", "mid")}

LABEL_ROWS = MAX_SESSIONS * len(REGIME_COLUMNS)


def attach(df: DataFrame, labels: DataFrame, column: str | None = None) -> DataFrame:
    """Inner join on date: sessions without a defined regime are dropped, not pooled."""
    wanted = labels if column is None else labels.filter(F.col("regime_column") == column)
    return df.join(broadcast_if_bounded(wanted, LABEL_ROWS), "date")


def buckets(labels: DataFrame) -> DataFrame:
    return labels.select("regime_column", "regime").distinct()


def conditional_ic(ic: DataFrame, labels: DataFrame, keys: Sequence[str], horizon: Column, min_dates: int = 30) -> DataFrame:
    """IC summary per regime bucket of one shared IC series; thin buckets are dropped."""
    by = [*keys, "regime_column", "regime"]
    joined = attach(ic, labels)
    enough = joined.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") >= min_dates)
    return summarize_ic(joined, by, horizon).join(enough.drop("_rows"), by, "left_semi")


def expand_map(names: DataFrame, factor_map: Sequence[tuple[str, str]]) -> DataFrame:
    """``(factor, prefix, regime_column)``: declared prefixes matched to concrete names.

    ``names`` holds one row per factor. A prefix matching nothing yields no row.
    """
    declared = F.array(
        *[F.struct(F.lit(p).alias("prefix"), F.lit(c).alias("regime_column")) for p, c in factor_map]
    )
    matched = F.filter(declared, lambda d: F.startswith(F.col("factor"), d["prefix"]))
    return names.select("factor", F.inline(matched))


def declared_experiments(names: DataFrame, labels: DataFrame, cfg: RegimeConfig) -> DataFrame:
    """One row per hypothesis: factor, regime column, favourable and unfavourable bucket."""
    seen = labels.groupBy("regime_column").agg(F.array_sort(F.collect_set("regime")).alias("_seen"))
    sides = F.create_map(
        *[
            x
            for c, (good, bad) in DECLARED_SIDES.items()
            for x in (F.lit(c), F.struct(F.lit(good).alias("good"), F.lit(bad).alias("bad")))
        ]
    )
    known = F.try_element_at(sides, F.col("regime_column"))
    good = F.when(known.isNotNull(), known["good"]).otherwise(F.try_element_at("_seen", F.lit(-1)))
    bad = F.when(known.isNotNull(), known["bad"]).otherwise(F.try_element_at("_seen", F.lit(1)))
    return (
        expand_map(names, cfg.factor_map)
        .join(seen, "regime_column")
        .withColumns({"favourable": good, "unfavourable": bad})
        .filter(
            (F.size("_seen") >= 2)
            & F.array_contains("_seen", F.col("favourable"))
            & F.array_contains("_seen", F.col("unfavourable"))
        )
        .select("factor", "prefix", "regime_column", "favourable", "unfavourable")
    )


def run_experiments(
    ic: DataFrame, labels: DataFrame, experiments: DataFrame, cfg: RegimeConfig, min_dates: int = 30
) -> DataFrame:
    """Difference in mean IC between the declared buckets with a robust t statistic."""
    stats = mean_errors(attach(ic, labels), ["factor", "regime_column", "regime"], "ic", "date")
    usable = F.col("n") >= 2

    def side(name: str, tag: str) -> DataFrame:
        return stats.select(
            "factor",
            "regime_column",
            F.col("regime").alias(name),
            F.when(usable, F.col("mean")).alias(f"ic_{name}"),
            F.when(usable, F.col("se")).alias(f"_se_{tag}"),
            F.col("n").alias(f"n_{name}"),
        )

    plain = ic.groupBy("factor").agg(F.avg("ic").alias("unconditional_ic"))
    rows = (
        experiments.join(side("favourable", "f"), ["factor", "regime_column", "favourable"], "left")
        .join(side("unfavourable", "u"), ["factor", "regime_column", "unfavourable"], "left")
        .join(plain, "factor")
    )
    se = F.sqrt(F.col("_se_f") * F.col("_se_f") + F.col("_se_u") * F.col("_se_u"))
    rows = rows.withColumns(
        {
            "difference": F.col("ic_favourable") - F.col("ic_unfavourable"),
            "se_difference": F.when(se > 0, se),
            "n_favourable": F.coalesce("n_favourable", F.lit(0)),
            "n_unfavourable": F.coalesce("n_unfavourable", F.lit(0)),
        }
    ).withColumn("t_stat", ratio(F.col("difference"), F.col("se_difference")))
    enough = (F.col("n_favourable") >= min_dates) & (F.col("n_unfavourable") >= min_dates)
    supported = enough & (F.col("difference") > 0) & (F.col("t_stat") >= cfg.gate_t)
    return rows.withColumn("supported", F.coalesce(supported, F.lit(False))).drop("_se_f", "_se_u")


def power_arguments(rows: DataFrame, cfg: RegimeConfig) -> DataFrame:
    """Effect sizes and normal arguments of the power calculation.

    Adequacy refers to a declared fraction of the unconditional IC, never to the observed
    difference.
    """
    se, size = F.col("se_difference"), F.abs("unconditional_ic")
    mde = (F.lit(cfg.gate_t) + F.lit(normal_quantile(cfg.power_target))) * se
    return rows.withColumns(
        {
            "reference_effect": F.lit(cfg.reference_fraction) * size,
            "observed_difference": F.abs("difference"),
            "detectable_50": F.lit(cfg.gate_t) * se,
            "mde": mde,
            "mde_over_ic": ratio(mde, F.when(size > 0, size)),
            "z_reference": ratio(F.lit(cfg.reference_fraction) * size, se) - F.lit(cfg.gate_t),
            "z_observed": ratio(F.abs("difference"), se) - F.lit(cfg.gate_t),
        }
    )


def with_power(rows: DataFrame, cfg: RegimeConfig) -> DataFrame:
    powered = power_arguments(rows, cfg).withColumns(
        {
            "power_at_reference": normal_cdf(F.col("z_reference")),
            "power_at_observed": normal_cdf(F.col("z_observed")),
        }
    )
    adequate = F.coalesce(F.col("power_at_reference") >= cfg.power_target, F.lit(False))
    return powered.withColumn("adequate", adequate)


def with_verdict(rows: DataFrame, cfg: RegimeConfig) -> DataFrame:
    """Categorical outcome and a sentence with the numbers behind it."""
    refuted = (F.col("difference") < 0) & (F.abs("t_stat") >= cfg.gate_t)
    label = (
        F.when(F.col("supported"), "SUPPORTED")
        .when(F.col("t_stat").isNull(), "INCONCLUSIVE (insufficient data)")
        .when(refuted, "REFUTED")
        .when(~F.col("adequate") & F.col("power_at_reference").isNull(), "INCONCLUSIVE (power unknown)")
        .when(~F.col("adequate"), "INCONCLUSIVE (underpowered)")
        .otherwise("NOT SUPPORTED")
    )
    detail = F.format_string(
        "%.0f%% power needs a difference of %.5f; %.0f%% power at the declared effect %.5f",
        F.lit(100.0 * cfg.power_target),
        F.col("mde"),
        F.lit(100.0) * F.col("power_at_reference"),
        F.col("reference_effect"),
    )
    return rows.withColumns({"verdict": label, "detail": detail})


def conditional_panel(
    panel: DataFrame,
    labels: DataFrame,
    column: str,
    active: Sequence[str],
    *,
    flat_outside: bool = True,
) -> DataFrame:
    """Keep the signal inside the active buckets; zero it (or drop the rows) elsewhere."""
    on = labels.filter((F.col("regime_column") == column) & F.col("regime").isin(*active)).select(
        "date", F.lit(True).alias("_on")
    )
    small = broadcast_if_bounded(on, MAX_SESSIONS)
    if not flat_outside:
        return panel.join(small, "date", "left_semi")
    return (
        panel.join(small, "date", "left")
        .withColumn("value", F.when(F.col("_on"), F.col("value")).otherwise(F.lit(0.0)))
        .drop("_on")
    )


def regime_exposure(labels: DataFrame, column: str, active: Sequence[str]) -> DataFrame:
    """Share of defined sessions inside the active buckets."""
    return labels.filter(F.col("regime_column") == column).agg(
        F.avg(F.col("regime").isin(*active).cast("double")).alias("exposure")
    )
