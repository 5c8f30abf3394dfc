"""Exact ranks and quantiles inside groups that may be arbitrarily large.

A window partitioned by ``date`` sends a whole cross-section to one task. Every operator
here works on *value buckets* instead: a deterministic, order-preserving coarse code of
the value. Bucket sizes are counted with map-side partial aggregation, turned into
offsets by a running sum over the (small) bucket table, and only then are rows ordered
inside one bucket. Equal values are collapsed to ``(value, count)`` before any shuffle,
so a value shared by a third of a group costs one row.

The code depends on the value alone, never on samples, so a recomputed task after an
executor loss lands every row in the same bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .numeric import broadcast_if_bounded

#: Buckets per factor of e in magnitude: neighbours differ by about 0.05 percent, so that even a
#: cross-section within a few percent fills hundreds of buckets.
RESOLUTION = 2048

#: ``ln`` of the smallest positive double is about -744.4.
_LN_FLOOR = 746


#: Rows of a group that one task may order by itself; larger groups go by value buckets.
GROUP_LIMIT = 200_000


def by_size(df: DataFrame, by: Sequence[str], limit: int = GROUP_LIMIT) -> tuple[DataFrame, DataFrame | None]:
    """``df`` parted into groups of at most ``limit`` rows, and the larger ones if there are any.

    Only counts per group are looked at, which partial aggregation makes before the shuffle; call it on a
    staged frame. A group without a key value counts as one.
    """
    large = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > limit).drop("_rows")
    large = stage(large, "large-groups")
    if large.isEmpty():
        return df, None
    keys = large.select([F.col(c).alias(f"_k{i}") for i, c in enumerate(by)])
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return df.join(keys, same, "left_anti"), df.join(keys, same, "left_semi")


def average_rank_over(by: Sequence[str], value: str) -> Column:
    """The average rank as a window over ``by``, for groups that one task may hold.

    The ties are counted over (by, value), which the same partitioning and order serve.
    """
    first = F.rank().over(Window.partitionBy(*by).orderBy(value))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, value))
    return first + (ties - 1) / F.lit(2.0)


def value_bucket(value: Column, resolution: int = RESOLUTION) -> Column:
    """Order-preserving BIGINT code of a finite double (log-spaced, signed)."""
    size = (F.floor(F.ln(F.abs(value)) * resolution) + _LN_FLOOR * resolution).cast("long")
    return F.when(value == 0, F.lit(0).cast("long")).when(value > 0, size).otherwise(-size)


def _running_before(total: str, by: Sequence[str], order: Sequence[str]) -> Column:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(total).over(w), F.lit(0))


def bucket_table(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """``(by, _vb, _size, _before, _n)``: counts per value bucket and rows ahead of it."""
    sizes = (
        df.withColumn("_vb", value_bucket(F.col(value)))
        .groupBy(*by, "_vb")
        .agg(F.count(F.lit(1)).alias("_size"))
    )
    whole = Window.partitionBy(*by)
    return sizes.withColumns(
        {"_before": _running_before("_size", by, ["_vb"]), "_n": F.sum("_size").over(whole)}
    )


def distinct_positions(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """``(by, value, _ties, _below, _n)`` for every distinct value of every group.

    ``_below`` counts strictly smaller rows, ``_ties`` the rows equal to the value.
    """
    tied = (
        df.groupBy(*by, value)
        .agg(F.count(F.lit(1)).alias("_ties"))
        .withColumn("_vb", value_bucket(F.col(value)))
    )
    heads = bucket_heads(tied, by)
    return (
        tied.withColumn("_inner", _running_before("_ties", [*by, "_vb"], [value]))
        .join(heads, [*by, "_vb"])
        .select(*by, value, "_ties", (F.col("_before") + F.col("_inner")).alias("_below"), "_n")
    )


def bucket_heads(tied: DataFrame, by: Sequence[str]) -> DataFrame:
    sizes = tied.groupBy(*by, "_vb").agg(F.sum("_ties").alias("_size"))
    return sizes.select(
        *by,
        "_vb",
        _running_before("_size", by, ["_vb"]).alias("_before"),
        F.sum("_size").over(Window.partitionBy(*by)).alias("_n"),
    )


def average_rank(
    df: DataFrame, by: Sequence[str], value: str, out: str
) -> DataFrame:
    """Add the 1-based rank with ties sharing their mean position; NULL values are dropped."""
    present = df.filter(F.col(value).isNotNull())
    return present.join(average_rank_table(present, by, value, out), [*by, value])


def average_rank_table(df: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """``(by, value, out)``: the average rank of every distinct value."""
    middle = F.col("_below") + (F.col("_ties") + F.lit(1)) / F.lit(2.0)
    return distinct_positions(df, by, value).select(*by, value, middle.cast("double").alias(out))


def ordinal_rank(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    tie: str,
    out: str,
    *,
    n_out: str | None = None,
    tie_code: Column | None = None,
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Add the 1-based position ordered by ``(value, tie)``; NULL values are dropped.

    Groups of up to ``limit`` rows are ordered by one task each, larger ones by buckets, where ``tie_code`` is an order-preserving coarse code of ``tie`` (for instance a fixed-length
    prefix). It spreads one heavily repeated value over several tasks.
    """
    light, heavy = by_size(df.filter(F.col(value).isNotNull()), by, limit)
    ranked = light.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(value, tie)).cast("long"))
    if n_out:
        ranked = ranked.withColumn(n_out, F.count(F.lit(1)).over(Window.partitionBy(*by)))
    if heavy is None:
        return ranked
    return ranked.unionByName(_ordinal_by_buckets(heavy, by, value, tie, out, n_out, tie_code))


def _ordinal_by_buckets(
    df: DataFrame, by: Sequence[str], value: str, tie: str, out: str, n_out: str | None, tie_code: Column | None
) -> DataFrame:
    present = df.withColumn("_tc", tie_code if tie_code is not None else F.lit(0))
    places = distinct_positions(present, by, value)
    keyed = [*by, value]
    blocks = present.groupBy(*keyed, "_tc").agg(F.count(F.lit(1)).alias("_block"))
    starts = (
        blocks.withColumn("_ahead", _running_before("_block", keyed, ["_tc"]))
        .join(places, keyed)
        .select(*keyed, "_tc", (F.col("_below") + F.col("_ahead")).alias("_start"), "_n")
    )
    inside = Window.partitionBy(*keyed, "_tc").orderBy(tie)
    ranked = (
        present.withColumn("_i", F.row_number().over(inside))
        .join(starts, [*keyed, "_tc"])
        .withColumn(out, (F.col("_start") + F.col("_i")).cast("long"))
    )
    if n_out:
        ranked = ranked.withColumn(n_out, F.col("_n").cast("long"))
    return ranked.drop("_tc", "_i", "_start", "_n")


def group_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probs: dict[str, float],
    *,
    max_groups: int | None = None,
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Exact linearly interpolated quantiles, one row per group.

    Groups of up to ``limit`` rows are ordered by one task each, in one shuffle. For larger ones it counts value buckets, locates the few buckets holding the wanted order statistics, and
    orders only the rows of those buckets; the rest never leaves its partition. A missing
    group key forms its own group.
    """
    light, heavy = by_size(df.filter(F.col(value).isNotNull()).select(*by, value), by, limit)
    whole = Window.partitionBy(*by)
    placed = light.withColumns({"_at": F.row_number().over(whole.orderBy(value)) - 1, "_n": F.count(F.lit(1)).over(whole)})
    wanted = [(n, p, end, f(F.lit(p) * (F.col("_n") - 1))) for n, p in probs.items() for end, f in (("lo", F.floor), ("hi", F.ceil))]
    picked = placed.groupBy(*by).agg(
        F.first("_n").alias("_n"), *[F.max(F.when(F.col("_at") == at, F.col(value))).alias(f"_{n}_{end}") for n, _, end, at in wanted]
    )
    if heavy is not None:
        picked = picked.unionByName(_order_statistics(heavy, by, value, probs, max_groups))

    def interpolate(name: str, p: float) -> Column:
        at = F.lit(p) * (F.col("_n") - 1)
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        return (lo + (hi - lo) * (at - F.floor(at))).alias(name)

    return picked.select(*by, *[interpolate(n, p) for n, p in probs.items()])


def _order_statistics(
    present: DataFrame, by: Sequence[str], value: str, probs: dict[str, float], max_groups: int | None
) -> DataFrame:
    """The values on both sides of each quantile, from the buckets that hold them."""
    targets = F.array(
        *[
            F.struct(F.lit(f"{name}_{end}").alias("name"), pos.cast("long").alias("pos"))
            for name, p in probs.items()
            for end, pos in (
                ("lo", F.floor(F.lit(p) * (F.col("_n") - 1))),
                ("hi", F.ceil(F.lit(p) * (F.col("_n") - 1))),
            )
        ]
    )
    inside = F.filter(
        targets,
        lambda t: (t["pos"] >= F.col("_before")) & (t["pos"] < F.col("_before") + F.col("_size")),
    )
    hits = (
        bucket_table(present, by, value)
        .select(*by, "_vb", "_before", "_n", inside.alias("_targets"))
        .filter(F.size("_targets") > 0)
    )
    bound = None if max_groups is None else max_groups * 2 * len(probs)
    ordered = (
        present.select(*by, value)
        .withColumn("_vb", value_bucket(F.col(value)))
        .join(broadcast_if_bounded(hits, bound), [*by, "_vb"])
        .groupBy(*by, "_vb", value)
        .agg(
            F.count(F.lit(1)).alias("_ties"),
            F.first("_before").alias("_before"),
            F.first("_n").alias("_n"),
            F.first("_targets").alias("_targets"),
        )
        .withColumn("_from", F.col("_before") + _running_before("_ties", [*by, "_vb"], [value]))
    )
    found = ordered.select(*by, value, "_n", "_from", "_ties", F.explode("_targets").alias("_t")).filter(
        (F.col("_t.pos") >= F.col("_from")) & (F.col("_t.pos") < F.col("_from") + F.col("_ties"))
    )
    return found.groupBy(*by).agg(
        F.first("_n").alias("_n"),
        *[
            F.max(F.when(F.col("_t.name") == f"{name}_{end}", F.col(value))).alias(f"_{name}_{end}")
            for name in probs
            for end in ("lo", "hi")
        ],
    )


def select_tails(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    tie: str,
    size: Column,
    *,
    tie_code: Column | None = None,
    max_groups: int | None = None,
    sides: Sequence[int] = (-1, 1),
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Rows among the ``size`` lowest (``side`` = -1) or highest (``side`` = +1) of a group.

    ``size`` is an expression over ``group_n`` (the group's non-NULL count); with both ``sides`` it should not
    pass half of it, as a row is given once. Groups of up to ``limit`` rows are ordered by one task each.
    Of larger ones, rows of buckets
    wholly inside a tail are accepted without being moved; only the two buckets straddling
    a cut-off are ranked exactly.
    """
    light, heavy = by_size(df.filter(F.col(value).isNotNull()), by, limit)
    whole = Window.partitionBy(*by)
    placed = light.withColumns({"_place": F.row_number().over(whole.orderBy(value, tie)), "group_n": F.count(F.lit(1)).over(whole)})
    placed = placed.withColumn("tail_n", size.cast("long"))
    low, high = F.col("_place") <= F.col("tail_n"), F.col("_place") > F.col("group_n") - F.col("tail_n")
    side = F.when(low & F.lit(-1 in sides), -1).when(high & F.lit(1 in sides), 1)
    tails = placed.withColumn("side", side).filter(F.col("side").isNotNull()).drop("_place")
    if heavy is None:
        return tails
    return tails.unionByName(_tails_by_buckets(heavy, by, value, tie, size, tie_code, max_groups, sides))


def _tails_by_buckets(
    present: DataFrame, by: Sequence[str], value: str, tie: str, size: Column, tie_code: Column | None,
    max_groups: int | None, sides: Sequence[int],
) -> DataFrame:
    table = bucket_table(present, by, value).withColumn("group_n", F.col("_n"))
    table = table.withColumn("_k", size.cast("long"))
    after = F.col("_before") + F.col("_size")
    low_edge = (F.col("_before") < F.col("_k")) & (after >= F.col("_k"))
    high_from = F.col("_n") - F.col("_k")
    high_edge = (F.col("_before") <= high_from) & (after > high_from)
    cuts = table.groupBy(*by).agg(
        F.first("group_n").alias("group_n"),
        F.first("_k").alias("_k"),
        F.max(F.when(low_edge, F.col("_vb"))).alias("_low_vb"),
        F.max(F.when(low_edge, F.col("_k") - F.col("_before"))).alias("_low_need"),
        F.max(F.when(high_edge, F.col("_vb"))).alias("_high_vb"),
        F.max(F.when(high_edge, high_from - F.col("_before"))).alias("_high_skip"),
    ).filter(F.col("_k") > 0)
    tagged = present.withColumn("_vb", value_bucket(F.col(value))).join(
        broadcast_if_bounded(cuts, max_groups), [*by]
    )
    below = (F.col("_vb") < F.col("_low_vb")) & F.lit(-1 in sides)
    above = (F.col("_vb") > F.col("_high_vb")) & F.lit(1 in sides)
    edge = (F.col("_vb") == F.col("_low_vb")) | (F.col("_vb") == F.col("_high_vb"))
    sure = tagged.filter(~edge & (below | above)).withColumn("side", F.when(below, -1).otherwise(1))
    ranked = _ordinal_by_buckets(tagged.filter(edge), [*by, "_vb"], value, tie, "_place", None, tie_code)
    in_low = below | ((F.col("_vb") == F.col("_low_vb")) & (F.col("_place") <= F.col("_low_need")) & F.lit(-1 in sides))
    in_high = above | ((F.col("_vb") == F.col("_high_vb")) & (F.col("_place") > F.col("_high_skip")) & F.lit(1 in sides))
    close = ranked.withColumn(
        "side", F.when(in_low, -1).when(in_high, 1)
    ).filter(F.col("side").isNotNull())
    helper = ["_vb", "_low_vb", "_low_need", "_high_vb", "_high_skip", "_place"]
    return sure.drop(*helper).unionByName(close.drop(*helper)).withColumnRenamed("_k", "tail_n")
