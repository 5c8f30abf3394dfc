"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint's bit is 1 if it is set in over half of the hashes of the text's 3-word shingles. Every
distinct fingerprint emits all variants within half the radius (itself and 64 single flips for radius
2); two fingerprints within the radius share one, so a shuffle on variants brings them together. At
most 65 fingerprints (at radius 2) lie in such a ball, which bounds every group without a cap.

Nulls, ties and odd input: a null text counts as empty; texts without words have fingerprint zero and
link like any other; texts of one or two words are one shingle. Rows without doc_id take part in links
but name no component; a component without any doc_id is null. Equal rows get equal results. An empty
table gives no rows. Only doc_id and text are read, so other columns' names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stage
from tidemark.llm.components import components
from tidemark.llm.registry import query, table

BITS = 64
SHINGLE = 3
RADIUS = 2
SEED = 42
#: Hashes counted at once; longer texts are counted in pieces.
CHUNK = 1 << 16


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a text as an unsigned number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII space only
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        hashes = [digest(joined, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
        hashes = [digest(joined[s:e], SEED) for s, e in spans]
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), CHUNK):
        raw = np.array(hashes[i : i + CHUNK], dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash and fp (the fingerprint's bits as a signed long) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.array([fingerprint(t, width) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(own)], names=["doc_id", "text_hash", "fp"])

    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    return narrow.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash bigint, fp bigint")


def ball(fp: Column, flips: int = 1) -> Column:
    """The fingerprint and all that differ from it in up to ``flips`` bits."""

    def around(x: Column) -> Column:
        single = F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: x.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
        return F.concat(F.array(x), single)

    found = around(fp) if flips else F.array(fp)
    for _ in range(flips - 1):
        found = F.array_distinct(F.flatten(F.transform(found, around)))
    return found


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) among distinct fingerprints that connect whatever lies within ``radius``.

    In a ball around a variant all members are within ``radius`` of each other, so linking each to the
    smallest one connects them all without listing pairs.
    """
    if radius < 0 or radius % 2:
        raise ValueError("a ball has half the radius, so the radius is even")
    shared = distinct.select("fp", F.explode(ball(F.col("fp"), radius // 2)).alias("variant"))
    hub = F.min("fp").over(Window.partitionBy("variant"))
    met = shared.withColumn("a", hub).where("a <> fp").select("a", F.col("fp").alias("b")).distinct()
    return met.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def grouped(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, text_hash, fp, c (the component's smallest fingerprint) and component_id of every row of ``docs``."""
    marked = stage(fingerprints(docs, width), "simhash")
    distinct = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    joined = components(links(distinct, radius), "simhash-links")
    # Fingerprints without a link are their own component.
    node = distinct.join(joined, distinct.fp == joined.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("c"))
    node = stage(node, "simhash-nodes")
    name = node.groupBy("c").agg(F.min("first").alias("component_id"))
    return marked.join(node.join(name, "c").select("fp", "c", "component_id"), "fp").select("doc_id", "text_hash", "fp", "c", "component_id")


def near_duplicates(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable) of every row of ``docs``."""
    return grouped(docs, width, radius).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of each component: that of its smallest doc_id, of equal doc_ids one row.

    Rows are told apart by doc_id and a hash of the text, so that a repeated doc_id loses no text of
    another component; rows without doc_id come last in their component.
    """
    key = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "text_hash")
    first = grouped(docs, width, radius).groupBy("c").agg(F.min(key).alias("__k"))
    first = first.select(F.col("__k.doc_id").alias("__keep"), F.col("__k.text_hash").alias("__hash"))
    named = docs.withColumn("__own", F.xxhash64(F.col("text").cast("string")))
    named = named.join(first, F.col("doc_id").eqNullSafe(F.col("__keep")) & (F.col("__own") == F.col("__hash")), "left_semi")
    order = [c for c in docs.columns if c != "doc_id"]
    one = Window.partitionBy("doc_id", "__own").orderBy(*order)
    return named.withColumn("__row", F.row_number().over(one)).where("__row = 1").select(*docs.columns)


@query("op6_simhash_groups")
def op6_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
