"""Incremental jobs: keyed accumulation, daily decisions and resumable ingestion.

Each job is a Structured Streaming query with an ``availableNow`` trigger: it processes what
has arrived since its checkpoint and stops. Output is written per batch id or per decision
date, so replaying a batch after a failure gives the same files.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.asof import _exists
from ..operators.calendar import with_position
from ..operators.quality import missing_sessions
from ..session import stage
from .desk import DailyDesk
from ..sources.sinks import read_keyed, upsert


def run_available(
    source: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, timeout: int | None = None
) -> None:
    """Drive one streaming frame through ``each(batch, id)`` until nothing is left."""
    query = (
        source.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(timeout)
    if query.exception() is not None:
        raise query.exception()


def file_stream(
    spark: SparkSession, path: str, schema: StructType | str, *, files_per_batch: int = 100, fmt: str = "parquet"
) -> DataFrame:
    return (
        spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)
    )


def accumulate_latest(
    spark: SparkSession,
    source: DataFrame,
    root: str,
    checkpoint: str,
    keys: Sequence[str],
    order: Sequence[str],
) -> DataFrame:
    """Keep the latest row per key across all batches; returns the current table."""
    def merge(batch: DataFrame, _: int) -> None:
        upsert(spark, batch, root, keys, order)

    run_available(source, merge, checkpoint)
    return read_keyed(spark, root, source.schema)


def _before(spark: SparkSession, path: str, batch_id: int, schema: StructType | str) -> DataFrame:
    """What the batches before ``batch_id`` stored; a batch that runs again does not read its own output."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(path).filter(F.col("batch") < batch_id)


def daily_decisions(spark: SparkSession, arrivals: DataFrame, desk: DailyDesk, root: str, checkpoint: str) -> DataFrame:
    """Run the desk over arriving sessions; returns the positions of all of them.

    ``arrivals`` streams ``(date)``. A micro-batch of any number of sessions is decided at once: it
    continues from what earlier batches left below ``root``, which is the ICs that had been realised
    (``ic``), the gate decisions (``gates``), the sessions decided (``decided``) and the last book
    (``state``). Each batch writes its own ``batch=<id>`` folders, so one that fails runs again to the same
    files. Sessions at or before the last decided one are not decided again.
    """
    kinds = {
        "ic": "factor string, pos int, ic double, batch int",
        "gates": "date date, pos int, factor string, on boolean, batch int",
        "decided": "date date, pos int, batch int",
        "state": "symbol string, weight double, batch int",
    }

    def step(batch: DataFrame, batch_id: int) -> None:
        past = {name: _before(spark, f"{root}/{name}", batch_id, schema) for name, schema in kinds.items()}
        done = past["decided"].agg(F.max("pos")).first()[0]
        done = -1 if done is None else done
        fresh = with_position(batch.select("date").distinct(), desk.sessions).filter(F.col("pos") > done)
        span = fresh.agg(F.min("pos").alias("first"), F.max("pos").alias("last")).first()
        if span["first"] is None:
            return
        newest = past["state"].agg(F.max("batch")).first()[0]
        opening = past["state"].filter(F.col("batch") == (-1 if newest is None else newest)).select("symbol", "weight")
        made = desk.decide(stage(fresh, "fresh"), done, span["first"], span["last"], past["ic"], past["gates"], opening)
        made["decided"] = fresh
        for name, frame in made.items():
            frame.write.mode("overwrite").parquet(f"{root}/{name}/batch={batch_id}")

    run_available(arrivals, step, checkpoint)
    positions = "date date, symbol string, prev_weight double, weight double, candidate boolean, banded boolean, adv double, cost_bps double, decided boolean"
    return spark.read.schema(positions).parquet(f"{root}/positions")


def resume_ingest(
    spark: SparkSession,
    source: DataFrame,
    parse: Callable[[DataFrame], DataFrame],
    root: str,
    checkpoint: str,
    sessions: DataFrame,
) -> tuple[DataFrame, DataFrame]:
    """Parse only files not seen before; report sessions still without any row.

    The file-source checkpoint remembers what was read. Returns ``(rows, missing)``; the
    missing sessions are listed, never filled.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        parse(batch).write.mode("overwrite").parquet(f"{root}/batch={batch_id}")

    run_available(source, append, checkpoint)
    rows = spark.read.option("basePath", root).parquet(root).drop("batch")
    return rows, missing_sessions(sessions, rows)
