"""Importance resampling towards a target distribution.

A text's features are its runs of ``least`` to ``most`` consecutive words, joined by one space. Each
feature falls in a hash bucket; the buckets' smoothed log ratio of target to corpus, summed over a
document's features, is its weight, and Gumbel noise from the document's id turns the highest scores
into a draw without replacement in proportion to the exponential of the weights.

Bucket hashes come from a position table. A CRC is linear over XOR, so that of a span is the XOR of one
table entry per byte, looked up by the byte and its distance from the span's end, and of a constant that
depends on the length alone. Whole Arrow batches are hashed at once: the entries of all spans lie in one
array that ``bitwise_xor.reduceat`` folds span by span. Spans longer than ``WIDTH`` bytes are cut into
blocks from their end; a block's value moves past the blocks behind it by tables for powers of two of
``WIDTH`` zero bytes, and a second fold joins the blocks. Texts are read in windows of ``WINDOW`` bytes that
end between words, and blocks in slices of ``SLICE``; this bounds the memory, whatever the length of a text.

What reaches the driver is one row per bucket, a number set by the caller. The draw sorts all scores over
range partitions and numbers them by the partitions' counts.

Nulls and odd input: a null or empty text has no features and weight 0; a null id counts as an empty
string in the noise and sorts last among ties; equal rows are documents of their own; ties go to the
smaller id; an empty target leaves every bucket its corpus counts alone; an empty table gives no rows;
texts and words may have any length; other columns are ignored, so that their names cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import part_offsets, ranged, stage
from tidemark.llm.registry import query, table
from tidemark.llm.sqltext import CRC_TABLE, crc32, lower_ascii

BUCKETS = 10_000
PERCENT = 10
SEED = 2024
LEAST_WORDS = 20
#: Distances from the end that the position table holds: bytes of a block.
WIDTH = 64
#: Blocks that are looked up at once.
SLICE = 1 << 14
#: Bytes of texts whose words are found at once.
WINDOW = 1 << 20
FULL = np.uint32(0xFFFFFFFF)

#: The register after one byte, by the byte; a CRC's start and end constants cancel out here.
STEP = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)


def past_zero(register: np.ndarray) -> np.ndarray:
    """The register after a zero byte."""
    return STEP[register & 255] ^ (register >> np.uint32(8))


def position_table(width: int) -> np.ndarray:
    """Row d holds what each byte gives when d bytes follow it."""
    rows = [STEP]
    for _ in range(width - 1):
        rows.append(past_zero(rows[-1]))
    return np.stack(rows)


POSITION = position_table(WIDTH).ravel()


def _leading() -> np.ndarray:
    """What the start register becomes after 0 to ``WIDTH`` bytes."""
    found = [np.array(FULL)]
    for _ in range(WIDTH):
        found.append(past_zero(found[-1]))
    return np.array(found, np.uint32)


LEADING = _leading()


def _first_move() -> np.ndarray:
    """Entry (k, v): the value v of a register's byte k after ``WIDTH`` zero bytes."""
    moved = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for _ in range(WIDTH):
        moved = past_zero(moved)
    return moved


#: Moves past 1, 2, 4, ... blocks; longer ones are appended when a span asks for them.
MOVES = [_first_move()]


def _apply(move: np.ndarray, register: np.ndarray) -> np.ndarray:
    return move[0][register & 255] ^ move[1][register >> 8 & 255] ^ move[2][register >> 16 & 255] ^ move[3][register >> 24]


def moved(register: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Registers after ``blocks`` blocks of zero bytes."""
    out = register.copy()
    for j in range(int(blocks.max(initial=0)).bit_length()):
        if j == len(MOVES):
            MOVES.append(_apply(MOVES[-1], MOVES[-1]))
        own = np.flatnonzero(blocks >> j & 1)
        out[own] = _apply(MOVES[j], out[own])
    return out


def span_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-32 of every span [start, end) of ``data``; spans may overlap and be empty."""
    length = ends - starts
    pieces = np.maximum(-(-length // WIDTH), 1)
    first = np.cumsum(pieces) - pieces
    # Blocks of a span in order; ``behind`` counts those after it.
    span = np.repeat(np.arange(len(starts)), pieces)
    behind = (first + pieces)[span] - 1 - np.arange(len(span))
    until = ends[span] - behind * WIDTH
    begin = np.maximum(starts[span], until - WIDTH)
    value = np.zeros(len(span), np.uint32)
    for s in range(0, len(span), SLICE):
        a, b = begin[s : s + SLICE], until[s : s + SLICE]
        some = np.flatnonzero(b > a)
        if not len(some):
            continue
        a, b = a[some], b[some]
        at = np.cumsum(b - a) - (b - a)
        where = np.arange(int((b - a).sum())) + np.repeat(a - at, b - a)
        entry = POSITION[(np.repeat(b - 1, b - a) - where) * 256 + data[where]]
        value[s + some] = np.bitwise_xor.reduceat(entry, at)
    if not len(span):
        return value
    folded = np.bitwise_xor.reduceat(moved(value, behind), first)
    whole, rest = length // WIDTH, length % WIDTH
    return folded ^ moved(LEADING[rest], whole) ^ FULL


BYTES = np.arange(256)
LOWER = np.where((BYTES >= 65) & (BYTES <= 90), BYTES + 32, BYTES).astype(np.uint8)
#: Bytes of words after lower-casing: digits, letters and all of non-ASCII characters.
IN_WORD = ((BYTES >= 48) & (BYTES <= 57)) | ((BYTES >= 97) & (BYTES <= 122)) | (BYTES >= 128)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(the bytes of all texts in a row, offsets of the texts), as they lie in the Arrow buffers."""
    texts = column.cast(pa.large_string())
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of every word of lower-cased bytes; a word also ends at every place of ``cuts``."""
    inside = np.concatenate([[False], IN_WORD[data], [False]])
    before, after = inside[:-1].copy(), inside[1:].copy()
    whole = before[cuts]
    before[cuts] = False
    starts = np.flatnonzero(after & ~before)
    before[cuts] = whole
    after[cuts] = False
    return starts, np.flatnonzero(before & ~after)


def windows(data: np.ndarray, offsets: np.ndarray, size: int = WINDOW) -> Iterator[tuple[int, int]]:
    """Runs [start, end) of about ``size`` bytes; no word goes over an end."""
    at = 0
    while at < len(data):
        stop = min(at + size, len(data))
        text_end = int(offsets[np.searchsorted(offsets, stop)])
        while stop < text_end:  # up to the next byte outside words
            free = np.flatnonzero(~IN_WORD[LOWER[data[stop : min(stop + size, text_end)]]])
            if len(free):
                stop += int(free[0])
                break
            stop = min(stop + size, text_end)
        yield at, stop
        at = stop


def features(data: np.ndarray, offsets: np.ndarray, least: int, most: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text of every word, text of every feature, bucket of every feature), window by window."""
    # The last words of the window before: their bytes with a space behind each, their lengths and texts.
    held, held_length, held_text = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for at, stop in windows(data, offsets):
        low = np.searchsorted(offsets, at, side="right") - 1
        own = offsets[low : np.searchsorted(offsets, stop)]
        part = LOWER[data[at:stop]]
        starts, ends = words(part, own[1:] - at)
        text = low + np.searchsorted(own, starts + at, side="right") - 1
        told = text
        if most > 1:  # write the words anew, one space behind each, after those held
            length = ends - starts
            fresh = np.cumsum(length + 1) - (length + 1)
            row = np.full(int((length + 1).sum()), 32, np.uint8)
            shift = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
            row[np.repeat(fresh, length) + shift] = part[np.repeat(starts, length) + shift]
            part, length, text = np.concatenate([held, row]), np.concatenate([held_length, length]), np.concatenate([held_text, text])
            starts = np.cumsum(length + 1) - (length + 1)
            ends = starts + length
        known = len(held_text)
        yield told, np.zeros(0, np.int64), np.zeros(0, np.uint32)
        for n in range(least, most + 1):
            # Runs that end before the first new word were given by the window before.
            first, last = max(known - n + 1, 0), len(starts) - n + 1
            if last > first:
                whole = first + np.flatnonzero(text[first:last] == text[first + n - 1 :])
                yield told[:0], text[whole], span_crcs(part, starts[whole], ends[whole + n - 1]) % np.uint32(buckets)
        if most > 1:
            keep = max(len(text) - most + 1, 0)
            held_length, held_text = length[keep:], text[keep:]
            held = part[starts[keep] :] if len(held_text) else part[:0]


def bucket_counts(texts: DataFrame, text: str = "text", least: int = 1, most: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: how many features of all texts fall in each bucket that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, found in features(*text_bytes(batch.column(0)), least, most, buckets):
                total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    column = F.col(text).cast("string").alias("text")
    return texts.select(column).mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain for all buckets, from the counts of ``bucket_counts``; a gain is in thousandths, rounded down."""
    every = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0)
    everything = Window.partitionBy()  # one row per bucket
    both = both.select("*", F.sum("s").over(everything).alias("all_s"), F.sum("t").over(everything).alias("all_t"))
    real = lambda c, more: F.col(c).cast("double") + more
    ratio = real("t", 1) * real("all_s", buckets) / (real("s", 1) * real("all_t", buckets))
    return both.select("bucket", F.floor(F.lit(1000) * F.log(ratio)).cast("long").alias("gain"))


def weights(docs: DataFrame, gain: np.ndarray, doc_id: str = "doc_id", text: str = "text", least: int = 1, most: int = 1) -> DataFrame:
    """doc_id, n_words, n_features, weight of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            n = batch.num_rows
            length, count, weight = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
            for word, own, bucket in features(data, offsets, least, most, len(gain)):
                length += np.bincount(word, minlength=n)
                count += np.bincount(own, minlength=n)
                weight += np.bincount(own, gain[bucket], n)
            columns = [batch.column(0), pa.array(length), pa.array(count), pa.array(weight.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def scored(weighted: DataFrame, seed: int = SEED) -> DataFrame:
    """``weighted`` with ``score``: the weight and Gumbel noise of the id, in thousandths."""
    told = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(told, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return weighted.withColumn("score", (F.col("weight") + noise).cast("long"))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED, least_words: int = LEAST_WORDS,
    least: int = 1, most: int = 1, buckets: int = BUCKETS,
) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document of ``docs`` (doc_id, text); ``rank`` numbers the drawn ones.

    Drawn are ``percent`` of the documents with at least ``least_words`` words, rounded down.
    """
    counted = [bucket_counts(t, least=least, most=most, buckets=buckets) for t in (docs, target)]
    gain = np.zeros(buckets, np.int64)
    for row in gains(*counted, buckets).collect():  # one row per bucket
        gain[row["bucket"]] = row["gain"]
    every = stage(scored(weights(docs, gain, least=least, most=most), seed), "importance")
    able = F.col("n_words") >= least_words
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight").desc(), F.col("n_features")]
    sorted_ = ranged(every.where(able), order, "importance-order")
    placed = sorted_.join(F.broadcast(part_offsets(sorted_, before=F.count("*"))), "__part")
    rank = F.col("before") + F.col("__pos") + 1
    drawn = F.floor(F.lit(percent) * F.col("before_all") / 100)
    columns = ["doc_id", "n_features", "weight", "score"]
    able_rows = placed.select(*columns, F.when(rank <= drawn, rank).cast("long").alias("rank"))
    return able_rows.unionByName(every.where(~able).select(*columns, F.lit(None).cast("long").alias("rank")))


_WORDS = f"regexp_extract_all({lower_ascii('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_NOISE = "(('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296"
SQL = f"""
WITH tab AS (SELECT {CRC_TABLE} AS tab),
words AS (SELECT true AS own, doc_id, unnest({_WORDS}) AS f FROM documents
          UNION ALL SELECT false, NULL, unnest({_WORDS}) FROM benchmark),
hashed AS (SELECT f, {crc32('f')} % 10000 AS bucket FROM (SELECT DISTINCT f FROM words), tab),
placed AS (SELECT own, doc_id, bucket FROM words JOIN hashed USING (f)),
counts AS (SELECT bucket, count(*) FILTER (own) AS s, count(*) FILTER (NOT own) AS t FROM placed GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE
          / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM counts),
weighed AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS weight FROM placed JOIN gains USING (bucket) WHERE own GROUP BY doc_id),
scored AS (SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
           (coalesce(weight, 0) + floor(-1000 * ln(-ln({_NOISE.replace('doc_id', 'd.doc_id')}))))::BIGINT AS score
           FROM documents d LEFT JOIN weighed w ON d.doc_id = w.doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
           count(*) FILTER (n_features >= 20) OVER () AS able FROM scored)
SELECT doc_id, n_features, weight, score,
       (CASE WHEN n_features >= 20 AND place <= 10 * able // 100 THEN place END)::BIGINT AS rank
FROM ranked
"""


@query("op11_importance_resampling", SQL)
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
