"""Helpers shared by the corpus operators: text columns, staged tables and ordered totals."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space that separates words in all contracts of this subpackage.
SPACE = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Positions inside one partition take the low bits of ``monotonically_increasing_id``.
ORDINAL_BITS = 33
#: Setting by which Spark removes the shuffle files of a query that has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder serves a single machine; on a cluster, whose
    executors would not see it, this is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base.rstrip('/')}/llm-{purpose}-{uuid.uuid4().hex}"


#: The tables that ``stage`` has written and nobody has released.
_WRITTEN: list[tuple[SparkSession, str]] = []


def staged() -> int:
    """A mark to release up to."""
    return len(_WRITTEN)


def release(mark: int = 0, keep: int = 0) -> None:
    """Delete what was staged since ``mark`` but for the last ``keep`` tables.

    For when results are stored: a frame that still reads one of the tables can run no more.
    """
    until = max(len(_WRITTEN) - keep, mark)
    for spark, path in _WRITTEN[mark:until]:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    del _WRITTEN[mark:until]


def stage(df: DataFrame, purpose: str) -> DataFrame:
    """Write a frame as a table in the shared folder and read it back; this cuts its lineage.

    ``release`` deletes such tables. Nothing reads the shuffles below once the table is there, so their files go when the write ends.
    """
    spark = df.sparkSession
    path = scratch(spark, purpose)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def bind(value: Column, body) -> Column:
    """``body`` applied to ``value``, which is evaluated once however often ``body`` uses it.

    Inside a lambda an ordinary column would be evaluated again for every element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def tasks(spark: SparkSession) -> int:
    """Partitions for an explicit exchange: those of the session's shuffles."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranged(df: DataFrame, keys: list, purpose: str) -> DataFrame:
    """Sort a frame globally and stage it with ``__part`` (int) and ``__pos`` (long, from 0).

    Range partitioning splits equal leading keys by the later ones, so that give keys whose
    tail is near unique. Only the staged table fixes the boundaries; everything later reads it.
    """
    spread = df.repartitionByRange(tasks(df.sparkSession), *keys).sortWithinPartitions(*keys)
    staged = stage(spread.withColumn("__ord", F.monotonically_increasing_id()), purpose)
    return staged.select(
        *df.columns,
        F.shiftright("__ord", ORDINAL_BITS).cast("int").alias("__part"),
        F.col("__ord").bitwiseAND((1 << ORDINAL_BITS) - 1).alias("__pos"),
    )


def part_offsets(df: DataFrame, **totals: Column) -> DataFrame:
    """For each ``__part`` the sums over all earlier parts, and with ``_all`` appended to the name those
    over all parts: one row per partition, no more."""
    per = df.groupBy("__part").agg(*[v.alias(k) for k, v in totals.items()])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return per.select(
        "__part",
        *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(k) for k in totals],
        *[F.sum(k).over(Window.partitionBy()).alias(f"{k}_all") for k in totals],
    )


def ranked(df: DataFrame, group: str, keys: list[str], name: str, buckets: int = 1024) -> DataFrame:
    """``df`` with a gapless number from 0 inside each ``group``, in an order that a hash of ``keys`` gives.

    A group is numbered bucket by bucket, so that one holding a third of all rows spreads over tasks.
    """
    rows = df.withColumn("_h", F.xxhash64(*keys)).withColumn("_b", F.pmod("_h", F.lit(buckets)))
    before = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per = rows.groupBy(group, "_b").agg(F.count("*").alias("_n"))
    base = per.select(F.col(group).alias("_g"), F.col("_b").alias("_gb"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(group, "_b").orderBy("_h", *keys)
    numbered = rows.withColumn("_in", F.row_number().over(inside) - 1)
    joined = numbered.join(base, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_b") == F.col("_gb")))
    return joined.select(*df.columns, (F.col("_base") + F.col("_in")).cast("long").alias(name))
