"""Sharding along a Hilbert curve.

Several metadata dimensions are quantised to ``BITS`` bits at equi-depth cut points, the cell's place
on the Hilbert curve is the leading sort key, and the sorted rows are cut into runs whose counts differ
by one at most (law ``rows``). Neighbouring cells share shards, so that a filter on any dimension skips
most files by their minima and maxima.

Order: curve, text hash, document hash, doc_id. Equal texts of one cell are adjacent; a group of copies
larger than a shard is cut by the later keys. Identical rows are interchangeable.

Nulls and odd input: strings count whole; texts may have any length (rows are sorted by their hashes); a null dimension falls in the lowest cell, a null text counts as empty (16 bytes of
size, CRC 0), an empty table gives no rows, other columns pass
through untouched, the added ones replace those of the same names, and names that begin with two
underscores are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import part_offsets, ranged
from tidemark.llm.registry import query, table

BITS = 4
SHARDS = 40
ROW_OVERHEAD = 16
#: Accuracy of the cut points' sketch.
SKETCH = 10_000
DIMENSIONS = ("source", "lang", "n_chars")


def hilbert(point: tuple[int, ...], bits: int) -> int:
    """The place of a cell on the Hilbert curve, by transposing the axes and undoing the Gray code."""
    x, top = list(point), 1 << (bits - 1)
    q = top
    while q > 1:
        for i in range(len(x)):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                swap = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= swap
                x[i] ^= swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip, q = 0, top
    while q > 1:
        if x[-1] & q:
            flip ^= q - 1
        q >>= 1
    index = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            index = index << 1 | ((v ^ flip) >> b & 1)
    return index


def is_string(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def measure(df: DataFrame, name: str) -> Column:
    """A dimension in its order, null lowest: strings by their UTF-8 bytes, anything else as a number."""
    if is_string(df, name):
        return F.coalesce(F.col(name), F.lit(""))
    return F.coalesce(F.col(name).cast("double"), F.lit(float("-inf")))


def string_cuts(df: DataFrame, name: str, bits: int) -> list[str]:
    """The values at which the sorted whole strings pass each 2^bits-th of all rows.

    Distinct values are counted with partial aggregation and sorted over range partitions, so that any
    number of them may exist; only the cut points reach the driver.
    """
    counts = df.groupBy(measure(df, name).alias("value")).agg(F.count("*").alias("n"))
    runs = ranged(counts, ["value"], "curve-values")
    before = F.broadcast(part_offsets(runs, **{"__before": F.sum("n")}))  # one row per range partition
    inside = Window.partitionBy("__part").orderBy("__pos")
    upto = F.col("__before") + F.sum("n").over(inside)
    placed = runs.join(before, "__part").withColumn("__upto", upto)
    share = lambda c: F.floor(c * (1 << bits) / F.col("__before_all"))
    passed = share(F.col("__upto")) > share(F.col("__upto") - F.col("n"))
    return sorted((r["value"] for r in placed.where(passed & (F.col("__upto") < F.col("__before_all"))).select("value").collect()), key=str.encode)


def cuts(df: DataFrame, dims: tuple[str, ...], bits: int) -> list[list]:
    """The distinct equi-depth cut points of each dimension, at most 2^bits - 1 values."""
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    numeric = [d for d in dims if not is_string(df, d)]
    row = df.agg(F.lit(0), *[F.percentile_approx(measure(df, d), shares, SKETCH).alias(f"c{i}") for i, d in enumerate(numeric)]).first()
    found = {d: sorted(set(row[f"c{i}"] or [])) for i, d in enumerate(numeric)}
    return [found[d] if d in found else string_cuts(df, d, bits) for d in dims]


def curve_index(df: DataFrame, dims: tuple[str, ...] = DIMENSIONS, bits: int = BITS) -> DataFrame:
    """``df`` with ``__curve``; the table of 2^(bits * dimensions) cells is made by rule and broadcast."""
    edges = cuts(df, dims, bits)
    cell = F.lit(0)
    for d, own in zip(dims, edges, strict=True):
        level = F.lit(0)
        for e in own:
            level = level + (measure(df, d) > e).cast("int")
        cell = cell * (1 << bits) + level
    side = 1 << bits
    points = [[c // side**i % side for i in range(len(dims) - 1, -1, -1)] for c in range(side ** len(dims))]
    places = df.sparkSession.createDataFrame(
        [(c, hilbert(tuple(p), bits)) for c, p in enumerate(points)], "__cell int, __curve int"
    )
    return df.withColumn("__cell", cell).join(F.broadcast(places), "__cell").drop("__cell")


def shard(df: DataFrame, dims: tuple[str, ...] = DIMENSIONS, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """``df`` as a table sorted along the curve, with ``shard`` and the gapless ``slot`` in it."""
    df = df.drop("curve_index", "shard", "slot")
    keyed = curve_index(df, dims, bits).withColumns(
        {"__text": F.xxhash64("text"), "__doc": F.xxhash64("doc_id")}
    )
    runs = ranged(keyed, ["__curve", "__text", "__doc", "doc_id"], "curve")
    # One row per range partition; their number is set by the session, not by the data.
    before = F.broadcast(part_offsets(runs, **{"__before": F.count("*")}))
    placed = runs.join(before, "__part").withColumn("__rank", F.col("__before") + F.col("__pos"))
    own = F.floor(F.col("__rank") * shards / F.col("__before_all"))
    first = F.ceil(own * F.col("__before_all") / shards)
    return placed.select(
        *df.columns, F.col("__curve").alias("curve_index"), own.cast("int").alias("shard"), (F.col("__rank") - first).cast("long").alias("slot")
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write one folder per shard; the rows of a file stay in curve order."""
    sharded.write.partitionBy("shard").parquet(path)


def shard_ranges(sharded: DataFrame, dims: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """Rows and the minimum and maximum of each dimension per shard, as a reader would prune by."""
    return sharded.groupBy("shard").agg(
        F.count("*").alias("rows"), *[f(d).alias(f"{k}_{d}") for d in dims for k, f in (("min", F.min), ("max", F.max))]
    )


@query("op8_hilbert_shards")
def op8_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard(table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    return placed.select(
        "doc_id",
        (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "curve_index",
    )
