"""Purged and embargoed K-fold roles over the session index, with a leakage check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .calendar import session_count


def purged_folds(sessions: DataFrame, n_splits: int = 6, horizon: int = 1, embargo: int = 0) -> DataFrame:
    """``(fold, date, pos, role)`` with role in train / test / purged / embargo.

    A session is purged when its label window ``[i, i + horizon]`` meets the label span of
    the test block, and embargoed when it lies within ``embargo`` sessions of it.
    """
    if n_splits < 2:
        raise ValueError("n_splits must be at least 2")
    if horizon < 1:
        raise ValueError("label horizon must be at least one session")
    if embargo < 0:
        raise ValueError("embargo cannot be negative")
    folds = F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1)))
    rows = sessions.select("date", "pos", session_count(sessions).alias("_n"), folds.alias("fold"))
    lo = F.floor(F.col("fold") * F.col("_n") / F.lit(n_splits)).cast("int")
    hi = F.floor((F.col("fold") + 1) * F.col("_n") / F.lit(n_splits)).cast("int")
    rows = rows.withColumns({"_lo": lo, "_hi": hi}).filter(
        (F.col("_hi") > F.col("_lo")) & (F.col("_n") >= n_splits)
    )
    p = F.col("pos")
    test = (p >= F.col("_lo")) & (p < F.col("_hi"))
    purged = (p + horizon >= F.col("_lo")) & (p <= F.col("_hi") - 1 + horizon)
    near = ((p >= F.col("_lo") - embargo) & (p < F.col("_lo"))) | (
        (p >= F.col("_hi")) & (p < F.col("_hi") + embargo)
    )
    role = F.when(test, "test").when(purged, "purged").when(near, "embargo").otherwise("train")
    return rows.select("fold", "date", "pos", role.alias("role"))


def leakage_check(folds: DataFrame, horizon: int) -> DataFrame:
    """Per fold: whether no training label window overlaps the test label span."""
    span = folds.filter("role = 'test'").groupBy("fold").agg(
        F.min("pos").alias("_lo"), F.max("pos").alias("_hi")
    )
    train = folds.filter("role = 'train'").join(span, "fold")
    overlap = (F.col("pos") + horizon >= F.col("_lo")) & (F.col("pos") <= F.col("_hi") + horizon)
    checked = train.groupBy("fold").agg(F.bool_and(~overlap).alias("clean"), F.count(F.lit(1)).alias("n_train"))
    return span.select("fold").join(checked, "fold", "left").select(
        "fold",
        F.coalesce("clean", F.lit(True)).alias("clean"),
        F.coalesce("n_train", F.lit(0)).cast("long").alias("n_train"),
    )
