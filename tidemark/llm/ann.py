"""Approximate nearest neighbours by an inverted multi-index.

The two halves of every vector are quantised by codebooks of their own, so that K centroids a half give
K x K cells. A query walks pairs of centroids by summed distance with a heap until the cells visited
hold the wanted share of all vectors; the vectors of those cells are reranked by exact inner product.

Small cells share blocks of bounded size and a large cell is cut into several, and queries go in chunks,
so that a cell holding a third of all vectors spreads over tasks; equal vectors are one entry that names its smallest ids.

The codebooks are fitted on at most ``SAMPLE`` vectors (those of smallest id hash); every vector is indexed.

Nulls, ties and odd input: vectors without id or that are null, zero, empty or hold null or non-finite components take
no part; ties go to the smaller id; an id that occurs twice with different vectors is two entries, and one query by both;
vectors of another length than most are an error; an empty table gives no rows; only the id and the
vector are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stage
from tidemark.llm.registry import query, table

#: Vectors that the codebooks are fitted on, at most.
SAMPLE = 20_000
#: Centroids of each half.
CENTROIDS = 64
ROUNDS = 12
#: Share of all entries that a query's cells hold; sets recall.
SHARE = 0.55
NEAREST = 20
#: Entries of a block and queries of a chunk.
BLOCK = 8192
CHUNK = 2048
FOUND = "query_id bigint, vec_id bigint, score double"


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0))


def kmeans(points: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of the sample by Lloyd's rounds from evenly spaced points; the same input gives the same."""
    order = np.lexsort(points.T[::-1])
    centres = points[order[np.linspace(0, len(points) - 1, min(k, len(points))).astype(int)]].copy()
    for _ in range(rounds):
        own = nearest(points, centres)
        for c in np.unique(own):
            centres[c] = points[own == c].mean(axis=0)
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1) - 2 * points @ centres.T, axis=1)


def codebooks(entries: DataFrame, k: int, sample: int) -> tuple[np.ndarray, np.ndarray] | None:
    """The centroids of both halves, from a sample of bounded size; None without vectors."""
    few = entries.select("vector").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    if not few:
        return None
    points = np.array([r["vector"] for r in few])
    half = points.shape[1] // 2
    return kmeans(points[:, :half], k), kmeans(points[:, half:], k)


def walk(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, wanted: int) -> list[int]:
    """Cells by summed distance until they hold ``wanted`` entries.

    ``first`` and ``second`` are a query's distances to the centroids; pairs come off a heap in order,
    and a pair enters once its two predecessors have left.
    """
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    da, db, ia, ib = first[a].tolist(), second[b].tolist(), a.tolist(), b.tolist()
    width, held, cells = len(ib), 0, []
    rows = [-1] * len(ia)  # how far each row has left the heap
    heap = [(da[0] + db[0], 0, 0)]
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        rows[i] = j
        cell = ia[i] * width + ib[j]
        if sizes[cell]:
            cells.append(cell)
            held += sizes[cell]
        if j + 1 < width and (i == 0 or rows[i - 1] > j):
            heapq.heappush(heap, (da[i] + db[j + 1], i, j + 1))
        if i + 1 < len(ia) and (j == 0 or rows[i + 1] == j - 1):
            heapq.heappush(heap, (da[i + 1] + db[j], i + 1, j))
    return cells


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of equally long lists as rows."""
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def search(vectors: DataFrame, queries: DataFrame, nearest_: int = NEAREST, k: int = CENTROIDS, share: float = SHARE, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found of every query (vec_id, vector), its own id left out.

    The measure is the inner product, so the distance between a half and a centroid is its negative.
    """
    spark = vectors.sparkSession
    # Equal vectors share an entry. A query's own id may be among the smallest, hence one more.
    alike = smallest_ids(vectors, nearest_ + 1)
    entries = stage(alike.withColumn("vec_id", F.element_at("ids", 1)), "ann-entries")
    books = codebooks(entries, k, sample)
    if books is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    half, width = books[0].shape[1], len(books[1])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column("vector"))
            cell = nearest(v[:, :half], books[0]) * width + nearest(v[:, half:], books[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], names=[*batch.schema.names, "cell"])

    celled = entries.mapInArrow(assign, "ids array<bigint>, vector array<double>, vec_id bigint, cell int")
    celled = stage(celled, "ann-cells")
    # At most K x K counts, whatever the number of vectors.
    counted = {r["cell"]: r["n"] for r in celled.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    sizes = np.zeros(len(books[0]) * width, np.int64)
    for cell, n in counted.items():
        sizes[cell] = n
    wanted = max(4 * nearest_, int(np.ceil(share * sizes.sum())))

    # Blocks of about BLOCK entries: small cells share one, a large cell is cut into several.
    first_block, n_blocks = blocks_of(sizes, BLOCK)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column("vector"))
            if v.shape[1] != half + books[1].shape[1]:
                raise ValueError("queries and vectors differ in length")
            first, second = -v[:, :half] @ books[0].T, -v[:, half:] @ books[1].T
            for i in range(len(v)):
                visits: dict[int, list[int]] = {}
                for cell in walk(first[i], second[i], sizes, wanted):
                    for block in range(first_block[cell], first_block[cell] + n_blocks[cell]):
                        visits.setdefault(block, []).append(cell)
                at = pa.array(np.full(len(visits), i))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(at), batch.column("vector").take(at), pa.array(visits.keys(), pa.int32()),
                        pa.array(visits.values(), pa.list_(pa.int32())),
                    ],
                    names=["query_id", "vector", "block", "cells"],
                )

    cut = [(int(c), int(first_block[c]), int(n_blocks[c])) for c in np.flatnonzero(sizes)]
    places = F.broadcast(spark.createDataFrame(cut, "cell int, _first int, _blocks int"))  # a row per cell
    part = F.floor(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) / (1 << 20) * F.col("_blocks"))
    blocks = celled.join(places, "cell").withColumn("block", (F.col("_first") + part).cast("int"))
    chunks = max(1, -(-queries.count() // CHUNK))
    asked = queries.distinct().mapInArrow(probe, "query_id bigint, vector array<double>, block int, cells array<int>")
    asked = asked.withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int"))
    blocks = blocks.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if left.num_rows and right.num_rows:
            q, v = matrix(left.column("vector")), matrix(right.column("vector"))
            cell, names = right.column("cell").to_numpy(), right.column("ids").to_pylist()
            for i, (own, cells) in enumerate(zip(left.column("query_id").to_pylist(), left.column("cells").to_pylist(), strict=True)):
                at = np.flatnonzero(np.isin(cell, cells))
                score = v[at] @ q[i]
                # One entry more, as the query's own may be among them; then all that tie with the last.
                few = min(nearest_ + 1, len(at))
                least = np.partition(score, len(at) - few)[len(at) - few] if few else 0.0
                best: list[tuple[float, int]] = []
                for j in at[score >= least - 1e-9 * max(1.0, abs(least))].tolist():
                    exact = float(np.dot(q[i], v[j]))
                    best += [(-exact, n) for n in names[j] if n != own]
                out += [(own, n, -s) for s, n in sorted(best)[:nearest_]]
        a, b, c = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})

    key = ("block", "chunk")
    met = asked.groupBy(*key).cogroup(blocks.groupBy(*key)).applyInArrow(rerank, FOUND)
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    met = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return met.withColumn("rank", best).where(F.col("rank") <= nearest_).select("query_id", "rank", "vec_id", "score")


def blocks_of(sizes: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(first block, number of blocks) of each cell."""
    first, count, now, held = np.zeros(len(sizes), int), np.ones(len(sizes), int), 0, 0
    for c, n in enumerate(sizes.tolist()):
        if held and held + n > block:
            now, held = now + 1, 0
        first[c], count[c] = now, max(1, -(-n // block))
        now, held = (now + count[c] - 1, n - (count[c] - 1) * block) if n > block else (now, held + n)
    return first, count


def smallest_ids(vectors: DataFrame, n: int) -> DataFrame:
    """One row per distinct vector with its ``n`` smallest ids, which are all that a ranking can name.

    Hash buckets reduce a vector that very many ids share before its ids meet in one row.
    """
    def reduce(df: DataFrame, by: list[str]) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*by).orderBy("vec_id"))
        return df.withColumn("_p", place).where(F.col("_p") <= n).drop("_p")

    salted = vectors.withColumn("_h", F.xxhash64("vector")).withColumn("_salt", F.pmod(F.xxhash64("vec_id"), F.lit(64))).distinct()
    few = reduce(reduce(salted, ["_h", "vector", "_salt"]), ["_h", "vector"])
    return few.groupBy("_h", "vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select("ids", "vector")


@query("op5_inverted_multi_index")
def op5_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return search(rows, rows.where("vec_id % 20 = 0"))
