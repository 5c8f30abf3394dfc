"""Table sinks, keyed upserts and result files."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .archives import keep_last


def write_panel(
    df: DataFrame, path: str, *, date: str = "date", name: str = "symbol", mode: str = "overwrite", files: int = 16
) -> None:
    """Panel parquet partitioned by month, so as-of reads prune whole directories.

    A month goes to ``files`` tasks by hash of its names, so that none writes a whole month.
    """
    month = F.date_format(date, "yyyy-MM").alias("month")
    (
        df.select("*", month)
        .repartition("month", F.pmod(F.xxhash64(name), F.lit(files)))
        .sortWithinPartitions(date)
        .write.mode(mode)
        .partitionBy("month")
        .parquet(path)
    )


def read_panel(spark: SparkSession, path: str, *, until: Column | None = None, date: str = "date") -> DataFrame:
    """Read back a monthly panel; ``until`` prunes both months and row groups."""
    df = spark.read.parquet(path)
    if until is not None:
        df = df.filter((F.col("month") <= F.date_format(until, "yyyy-MM")) & (F.col(date) <= until))
    return df.drop("month")


def write_result(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Result table as parquet, CSV (with header) or JSON lines."""
    if fmt not in ("parquet", "csv", "json"):
        raise ValueError(f"unsupported result format {fmt!r}")
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


#: Hash buckets of a keyed table; a merge rewrites only those that its rows touch.
UPSERT_BUCKETS = 64
#: Manifests that stay readable: a frame made from one can be read until so many merges have followed.
KEPT_MANIFESTS = 3


class ConcurrentMerge(RuntimeError):
    """Two merges started from the same table; the later one to end was not applied."""


class _Files:
    """The few file operations that a keyed table needs, on whatever store the session reads."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.root = spark.sparkContext._jvm, root.rstrip("/")
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, name: str) -> list[str]:
        where = self.path(name)
        return sorted(x.getPath().getName() for x in self.fs.listStatus(where)) if self.fs.exists(where) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write_new(self, name: str, text: str) -> bool:
        """Put a whole file in place at once; False if there is one already."""
        draft = self.path(f"_log/.draft-{uuid.uuid4().hex}")
        stream = self.fs.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        files = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.conf)
        options = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            files.rename(files.makeQualified(draft), files.makeQualified(self.path(name)), options)
        except Py4JJavaError as e:
            self.fs.delete(draft, False)
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        return True

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def _manifests(files: _Files) -> list[int]:
    return sorted(int(n[:-5]) for n in files.names("_log") if n.endswith(".json") and not n.startswith("."))


def _manifest(files: _Files, number: int) -> dict[int, str]:
    """Bucket -> folder below the root, as merge ``number`` left them."""
    return {int(b): f for b, f in json.loads(files.read(f"_log/{number:012d}.json")).items()}


def _current(files: _Files) -> tuple[int, dict[int, str]]:
    numbers = _manifests(files)
    return (numbers[-1], _manifest(files, numbers[-1])) if numbers else (-1, {})


def read_keyed(spark: SparkSession, root: str, schema: StructType | str) -> DataFrame:
    """The rows of a keyed table as its last merge left them."""
    files = _Files(spark, root)
    paths = [f"{files.root}/{f}" for f in _current(files)[1].values()]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*paths)


def _expire(files: _Files) -> None:
    """Drop manifests beyond the kept ones and the bucket folders that no kept one names."""
    numbers = _manifests(files)
    old, kept = numbers[:-KEPT_MANIFESTS], numbers[-KEPT_MANIFESTS:]
    if not old:
        return
    live = {f for n in kept for f in _manifest(files, n).values()}
    stale = {f for n in old for f in _manifest(files, n).values()} - live
    for folder in stale:
        files.delete(folder)
        merge = folder.rsplit("/", 1)[0]
        if not any(x.startswith("bucket=") for x in files.names(merge)):
            files.delete(merge)
    for n in old:
        files.delete(f"_log/{n:012d}.json")


def upsert(
    spark: SparkSession, new_rows: DataFrame, root: str, keys: Sequence[str], order: Sequence[str], *, buckets: int = UPSERT_BUCKETS
) -> DataFrame:
    """Merge rows into the keyed table under ``root``, the latest arrival winning; returns the table.

    A merge writes the buckets of its own keys anew, one file each, to a folder that no reader knows, and
    then puts the next numbered manifest in place, which names a folder for every bucket. That one rename
    is the commit: readers see the table before or after it. A merge that fails, comes twice or comes after
    a lost stream checkpoint loses no row, since the same rows merge to the same table. Where another
    merge has taken the number meanwhile, ``ConcurrentMerge`` is raised and nothing has changed. What
    only older manifests name is deleted, so the files do not grow with the number of merges.
    """
    schema, files = new_rows.schema, _Files(spark, root)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    touched = [r[0] for r in new_rows.select(bucket.alias("bucket")).distinct().collect()]  # at most ``buckets`` numbers
    if not touched:
        return read_keyed(spark, root, schema)
    number, here = _current(files)
    before = [f"{files.root}/{here[b]}" for b in touched if b in here]
    merged = new_rows if not before else spark.read.schema(schema).parquet(*before).unionByName(new_rows)
    latest = keep_last(merged, keys, [F.col(c) for c in order]).select(*new_rows.columns)
    own = f"data/{uuid.uuid4().hex}"
    latest.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(f"{files.root}/{own}")
    after = here | {b: f"{own}/bucket={b}" for b in touched}
    if not files.write_new(f"_log/{number + 1:012d}.json", json.dumps(after)):
        files.delete(own)
        raise ConcurrentMerge(f"{root}: merge {number + 1} was committed by another writer; run this one again")
    _expire(files)
    return read_keyed(spark, root, schema)
