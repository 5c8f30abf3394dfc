"""Session defaults and the shared scratch location."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidemark")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str | None:
    """The shared folder the cluster names, or None on a single machine."""
    return spark.conf.get("spark.checkpoint.dir", None)


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for written tables and stream state.

    Lives under ``spark.checkpoint.dir``, which a cluster points at shared storage. Only
    where that is unset (tests on one machine) is a temporary folder used.
    """
    base = shared_root(spark)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base.rstrip('/')}/tidemark-{purpose}-{uuid.uuid4().hex}"


_STAGED: list[DataFrame] = []
_WRITTEN: list[tuple[SparkSession, str]] = []


def stage(df: DataFrame, purpose: str = "stage") -> DataFrame:
    """Materialise a frame that several branches of one plan read.

    Where the cluster names a shared folder in ``spark.checkpoint.dir`` the frame becomes a
    parquet table there: it cuts the lineage and outlives lost executors. Otherwise the
    frame is persisted lazily and recomputed from lineage if a block disappears.
    """
    spark = df.sparkSession
    if shared_root(spark) is None:
        held = df.persist(StorageLevel.MEMORY_AND_DISK)
        _STAGED.append(held)
        return held
    path = scratch_dir(spark, purpose)
    df.write.parquet(path)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release_staged() -> None:
    """Drop what finished plans staged: persisted frames and written tables.

    Call it once results are stored; a plan that still reads a written table can run no more.
    """
    while _STAGED:
        _STAGED.pop().unpersist()
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
