"""Token ids in files of directly addressable codes.

An id is cut into 8-bit chunks, lowest first. Level 0 holds the first chunk of every id, level k the
(k+1)-th chunk of those ids that have one; a bitmap per level says which of its codes go on, and a
rank directory counts the set bits before every 512th. So any token is read by one rank per level,
without decoding what stands before it. A file is one segment: documents in ascending doc_id order.

Layout, little-endian: magic ``DAC1``, sequence number, documents, tokens and levels (4 signed
64-bit), doc_ids, a byte per document that is 1 for a null doc_id, document starts (documents + 1),
then per level its length, codes, bitmap and directory. Every part is padded to 8 bytes; the file ends
with a line feed, which Spark's text writer adds.

Nulls, ties and odd input: a null text counts as empty, so its document has the end id only; null
doc_ids come first; equal doc_ids are ordered by text; an empty table writes no segment and reads back no
rows; only doc_id and text are read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ORDINAL_BITS, scratch, stage, tasks
from tidemark.llm.registry import query, table
from tidemark.llm.tokens import END, encoder, tokenizer_path

MAGIC = b"DAC1\0\0\0\0"
RANK_STEP = 512
#: A segment is closed once it holds so many tokens; one document is never cut.
SEGMENT_TOKENS = 1 << 22
VOCABULARY = "word_bpe_49k.json"
RESULT = "seq bigint, place int, doc_id bigint, first bigint, n_tokens bigint, ids_crc32 bigint"


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % 8)


def encode_segment(seq: int, doc_ids: list[int | None], starts: np.ndarray, ids: np.ndarray) -> bytes:
    """The bytes of one segment; ``ids`` are unsigned 32-bit, ``starts`` has one entry more than documents."""
    levels, rest = [], ids.astype("<u4")
    while len(rest):
        more = rest > 0xFF
        codes, bits = (rest & 0xFF).astype(np.uint8), np.packbits(more, bitorder="little")
        full = np.zeros(-(-len(rest) // RANK_STEP) * RANK_STEP, bool)
        full[: len(rest)] = more
        before = np.concatenate([[0], np.cumsum(full.reshape(-1, RANK_STEP).sum(axis=1))[:-1]]).astype("<i8")
        levels.append((len(rest), codes, bits, before))
        rest = rest[more] >> 8
    out = [MAGIC, struct.pack("<4q", seq, len(doc_ids), len(ids), len(levels))]
    out.append(np.array([d or 0 for d in doc_ids], "<i8").tobytes())
    out.append(padded(bytes(d is None for d in doc_ids)))
    out.append(starts.astype("<i8").tobytes())
    for n, codes, bits, before in levels:
        out += [struct.pack("<q", n), padded(codes.tobytes()), padded(bits.tobytes()), before.tobytes()]
    return b"".join(out)


class Segment:
    """Random access to a segment's bytes."""

    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        self.seq, docs, self.n_tokens, levels = struct.unpack_from("<4q", raw, 8)
        at = 40

        def take(dtype: str, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(raw, dtype, n, at)
            at += got.nbytes + -got.nbytes % 8
            return got

        ids, missing = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if m else i for i, m in zip(ids.tolist(), missing.tolist(), strict=True)]
        self.starts, self.levels = take("<i8", docs + 1), []
        for _ in range(levels):
            n = int(take("<i8", 1)[0])
            self.levels.append((n, take("u1", n), take("u1", -(-n // 8)), take("<i8", -(-n // RANK_STEP))))

    def _more(self, level: int, i: int) -> bool:
        return bool(self.levels[level][2][i >> 3] >> (i & 7) & 1)

    def _rank(self, level: int, i: int) -> int:
        """Set bits before position ``i``: the directory, then the bytes since its last entry."""
        n, _, bits, before = self.levels[level]
        if i == 0:
            return 0
        step = min(i // RANK_STEP, len(before) - 1)
        own = bits[step * RANK_STEP // 8 : -(-i // 8)]
        tail = np.unpackbits(own, count=i - step * RANK_STEP, bitorder="little")
        return int(before[step]) + int(tail.sum(dtype=np.int64))

    def token(self, i: int) -> int:
        """The id of token ``i`` of the segment."""
        value, level = int(self.levels[0][1][i]), 0
        while self._more(level, i):
            i = self._rank(level, i)
            level += 1
            value |= int(self.levels[level][1][i]) << 8 * level
        return value

    def tokens(self, start: int, end: int) -> np.ndarray:
        """The ids of a run of tokens; only the run's codes are read."""
        found, at, level = np.zeros(end - start, "<u4"), np.arange(end - start), 0
        while end > start:
            codes, bits = self.levels[level][1][start:end], self.levels[level][2]
            found[at] |= codes.astype("<u4") << 8 * level
            own = np.unpackbits(bits[start // 8 : -(-end // 8)], bitorder="little")[start % 8 :][: end - start]
            at = at[own.astype(bool)]
            start, end, level = self._rank(level, start), self._rank(level, end), level + 1
        return found


def segments(docs: DataFrame, path: str, drops_space: bool, end_id: int | None = END, size: int = SEGMENT_TOKENS) -> DataFrame:
    """One row per segment (``segment`` binary) of ``docs``, which must be sorted within partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seq = encoder(path, drops_space), TaskContext.get().partitionId() << ORDINAL_BITS
        end = b"" if end_id is None else struct.pack("<I", end_id)
        ids, parts, total = [], [], 0

        def close() -> pa.RecordBatch:
            starts = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])])
            blob = encode_segment(seq, ids, starts, np.frombuffer(b"".join(parts), "<u4"))
            return pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], names=["segment"])

        for batch in batches:
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), enc.encode(batch.column("text").to_pylist()), strict=True):
                ids.append(doc_id)
                parts.append(raw + end)
                total += len(parts[-1]) // 4
                if total >= size:
                    yield close()
                    seq, ids, parts, total = seq + 1, [], [], 0
        if ids:
            yield close()

    return docs.mapInArrow(run, "segment binary")


def write_tokens(docs: DataFrame, path: str, drops_space: bool = True, out: str | None = None, **kinds) -> str:
    """Write all documents in ascending doc_id order; returns the folder of the files."""
    spark = docs.sparkSession
    out = out or scratch(spark, "dac")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # The hash splits a doc_id that very many rows share.
    keys = ["doc_id", F.xxhash64("text")]
    ordered = rows.repartitionByRange(tasks(spark), *keys).sortWithinPartitions(*keys)
    blobs = segments(ordered, path, drops_space, **kinds)
    # Spark's writer works on any store and keeps a failed task's files out; it writes the bytes as they are.
    blobs.select(F.col("segment").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(out)
    return out


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files under ``path``: its segment's ``seq``, ``place`` in it, doc_id, the ids'
    ``first`` place in the segment, n_tokens and ids_crc32 (of the ids as unsigned 32-bit, little-endian)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("content"):
                own = Segment(raw.as_py())
                n = len(own.doc_ids)
                crc = [zlib.crc32(own.tokens(int(s), int(e)).tobytes()) for s, e in zip(own.starts[:-1], own.starts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([own.seq] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(own.doc_ids, pa.int64()),
                        pa.array(own.starts[:-1]), pa.array(np.diff(own.starts)), pa.array(crc, pa.int64()),
                    ],
                    names=["seq", "place", "doc_id", "first", "n_tokens", "ids_crc32"],
                )

    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").load(path)
    return files.select("content").mapInArrow(run, RESULT)


def with_start(read: DataFrame) -> DataFrame:
    """``start``: the ids of all documents before, over all segments; a running sum over segments only."""
    read = stage(read, "dac-read")
    per = read.groupBy("seq").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("seq", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return read.join(base, "seq").withColumn("start", F.col("_base") + F.col("first")).drop("_base")


@query("op3_addressable_codes")
def op3_addressable_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_tokens(table(spark, sf_dir, "documents"), tokenizer_path(VOCABULARY))
    return with_start(read_tokens(spark, files)).select("doc_id", "start", "n_tokens", "ids_crc32")
