"""Packing documents into sequences by minimum bin slack.

For each bin the largest piece left is set, and a bitset subset-sum over the lengths left finds the
fullest feasible combination with it, which is then removed. Pieces of one length are alike, so the
search runs on the histogram of lengths (at most ``capacity`` entries, whatever the input's size): a
combination is taken as often as the counts allow, and the pieces, numbered within their length, look up
their bin in the resulting table.

Nulls, ties and odd input: a null text is an empty one and packs as its end id; pieces of equal length
are interchangeable; equal rows are packed each; an empty table gives no rows; only doc_id and text are
read, so other columns' names cannot clash.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import ranked, stage
from tidemark.llm.registry import query, table
from tidemark.llm.tokens import END, encoder, tokenizer_path

CAPACITY = 1024
VOCABULARY = "byte_bpe_50k.json"
PIECE = "doc_id bigint, piece int, start bigint, length int, ids_crc32 bigint"


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length make the largest sum up to ``room``; larger lengths are preferred.

    ``lengths`` ascend. Bit s of a set is 1 if the lengths so far can sum to s; a length's count is
    added in doubling steps.
    """
    mask, reach, sets = (1 << room + 1) - 1, 1, [1]
    used = [n for n in lengths if n <= room and counts[n]]
    for n in used:
        left, step = min(counts[n], room // n), 1
        while left:
            take = min(step, left)
            reach |= reach << n * take & mask
            left -= take
            step *= 2
        sets.append(reach)
    total, chosen = reach.bit_length() - 1, {}
    for i in range(len(used) - 1, -1, -1):
        n, k = used[i], min(counts[used[i]], total // used[i])
        while k and not sets[i] >> total - n * k & 1:
            k -= 1
        if k:
            chosen[n] = k
            total -= n * k
    return chosen


def combinations(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(pieces of each length in a bin, number of such bins) until the histogram is used up."""
    counts, found = dict(histogram), []
    lengths = sorted(n for n, c in counts.items() if c)
    while lengths:
        top = lengths[-1]
        counts[top] -= 1
        bin_ = fullest(lengths, counts, capacity - top)
        counts[top] += 1
        bin_[top] = bin_.get(top, 0) + 1
        times = min(counts[n] // k for n, k in bin_.items())
        for n, k in bin_.items():
            counts[n] -= k * times
        lengths = [n for n in lengths if counts[n]]
        found.append((bin_, times))
    return found


def intervals(found: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """For each length its rank intervals: first rank, first sequence, pieces per bin, first offset."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for bin_, times in found:
        offset = 0
        for n in sorted(bin_, reverse=True):
            rows.setdefault(n, []).append((ranks.get(n, 0), sequence, bin_[n], offset))
            ranks[n] = ranks.get(n, 0) + bin_[n] * times
            offset += n * bin_[n]
        sequence += times
    return {n: np.array(r, np.int64) for n, r in rows.items()}


def place(pieces: DataFrame, capacity: int = CAPACITY, keys: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``pieces`` (with ``length`` from 1 to ``capacity``) with sequence_id and offset."""
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if any(not 1 <= n <= capacity for n in histogram):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    table_ = intervals(combinations(histogram, capacity))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                own, at = table_[int(n)], np.flatnonzero(length == n)
                row = own[np.searchsorted(own[:, 0], rank[at], side="right") - 1]
                k = rank[at] - row[:, 0]
                sequence[at], offset[at] = row[:, 1] + k // row[:, 2], row[:, 3] + k % row[:, 2] * n
            kept = [c for c in batch.schema.names if c != "_rank"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"]
            )

    numbered = ranked(pieces, "length", list(keys), "_rank")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    return numbered.mapInArrow(run, f"{fields}, sequence_id bigint, offset bigint")


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: all full but the first."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *[(s, capacity) for s in range(first, n, capacity)]] if n else []


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END, with_ids: bool = False) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path), struct.pack("<I", end_id)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), enc.encode(batch.column("text").to_pylist()), strict=True):
                raw += end
                for i, (s, n) in enumerate(cut(len(raw) // 4, capacity)):
                    own = raw[4 * s : 4 * (s + n)]
                    rows.append((doc_id, i, s, n, zlib.crc32(own), *([np.frombuffer(own, "<i4")] if with_ids else [])))
            columns = list(zip(*rows, strict=True)) or [[]] * (5 + with_ids)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), *([pa.list_(pa.int32())] if with_ids else [])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, PIECE + (", ids array<int>" if with_ids else ""))


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Where every piece of ``docs`` stands: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return place(stage(token_pieces(docs, path, capacity), "pieces"), capacity)


@query("op9_min_slack_packing")
def op9_min_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = pack(table(spark, sf_dir, "documents"), tokenizer_path(VOCABULARY))
    return placed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")
