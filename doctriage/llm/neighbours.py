"""Nearest neighbours by a block matrix join with quantised products and exact survivors.

Vectors are packed into blocks of bounded bytes.  Query blocks and candidate blocks meet in tiles, so
a task holds one stripe of each.  In a tile, int8 products bound every cosine from both sides; pairs
whose upper bound cannot reach a query's k-th best are dropped, the others are recomputed in double
precision and pushed into one heap per query.  The heaps of all tiles are then merged.

The bounds are proven per pair, so the result is exact.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 2048
BLOCK_BYTES = 4 * 1024 * 1024
STRIPE_BYTES = 16 * 1024 * 1024
SLACK = 1e-6
# Products of int8 codes are whole numbers that single precision holds exactly up to this length.
EXACT_LENGTH = 2**24 // 127**2

BLOCK_SCHEMA = "source int, seq int, length int, ids binary, vectors binary"


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null or empty, every component finite, not all zero."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))
    return F.coalesce(
        vector.isNotNull()
        & (F.size(vector) > 0)
        & F.forall(vector, number)
        & F.exists(vector, lambda x: x != 0),
        F.lit(False),
    )


def pack(rows: DataFrame) -> DataFrame:
    """Pack ``id, vector`` (double components) into blocks of at most ``BLOCK_ROWS`` equally long
    vectors and ``BLOCK_BYTES`` (one vector at least), where they lie: nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        source, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(1)
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            values = lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
            for length in np.unique(lengths):
                own = np.flatnonzero(lengths == length)
                height = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * int(length))))
                for at in range(0, len(own), height):
                    part = own[at : at + height]
                    block = values[starts[part][:, None] + np.arange(length)]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "source": pa.array([source], pa.int32()),
                            "seq": pa.array([seq], pa.int32()),
                            "length": pa.array([int(length)], pa.int32()),
                            "ids": [ids[part].astype(np.int64).tobytes()],
                            "vectors": [block.astype(np.float64).tobytes()],
                        }
                    )
                    seq += 1

    return rows.select(
        F.col("id").cast("long"), F.col("vector").cast("array<double>")
    ).mapInArrow(run, BLOCK_SCHEMA)


class Quantised:
    """Unit vectors as int8 codes with a scale and a bound on what the codes lose."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        # Scaling by the largest component first keeps squares in range.
        largest = np.abs(vectors).max(axis=1, keepdims=True)
        unit = vectors / largest
        unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
        self.scale = np.abs(unit).max(axis=1) / 127
        codes = np.rint(unit / self.scale[:, None]).astype(np.int8)
        lost = unit - codes * self.scale[:, None]
        self.error = np.sqrt((lost * lost).sum(axis=1))
        exact = np.float32 if vectors.shape[1] <= EXACT_LENGTH else np.float64
        self.codes = codes.astype(exact)


def cosines(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Cosines of paired rows; components are added in order, so equal vectors get equal scores."""
    product, own, other = (np.zeros(len(left)) for _ in range(3))
    for i in range(left.shape[1]):
        x, y = left[:, i], right[:, i]
        product += x * y
        own += x * x
        other += y * y
    return np.clip(product / np.sqrt(own * other), -1.0, 1.0)


class Heaps:
    """The ``k`` best candidates of each query; ties go to the smaller id, an id counts once."""

    def __init__(self, count: int, k: int):
        self.k = k
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(count)]

    def floors(self) -> np.ndarray:
        return np.array([h[0][0] if len(h) == self.k else -math.inf for h in self.heaps])

    def push(self, query: int, score: float, candidate: int) -> None:
        heap, item = self.heaps[query], (score, -candidate)
        for at, (old, name) in enumerate(heap):
            if name == -candidate:
                if old < score:
                    heap[at] = item
                    heapq.heapify(heap)
                return
        if len(heap) < self.k:
            heapq.heappush(heap, item)
        elif item > heap[0]:
            heapq.heapreplace(heap, item)


def k_best(queries: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's ``k`` best pairs, an id once; ties go to the smaller id."""
    order = np.lexsort((-scores, ids, queries))
    asked, named = queries[order], ids[order]
    first = np.append(True, (asked[1:] != asked[:-1]) | (named[1:] != named[:-1]))
    order = order[first]
    order = order[np.lexsort((ids[order], -scores[order], queries[order]))]
    _, starts, counts = np.unique(queries[order], return_index=True, return_counts=True)
    return order[np.arange(len(order)) - np.repeat(starts, counts) < k]


def search_tile(queries: Quantised, rows: Quantised, heaps: Heaps) -> None:
    """Offer every row of one candidate block to the heaps of one query block."""
    near = (queries.codes @ rows.codes.T).astype(np.float64)
    near *= queries.scale[:, None]
    near *= rows.scale[None, :]
    margin = queries.error[:, None] + (1 + queries.error[:, None]) * rows.error[None, :] + SLACK
    own = queries.ids[:, None] == rows.ids[None, :]
    lower = np.where(own, -math.inf, near - margin)
    floor = heaps.floors()
    # The k-th lower bound of a block is a floor only if its ids differ, since an id counts once.
    k = heaps.k
    if rows.codes.shape[0] > k and len(np.unique(rows.ids)) == len(rows.ids):
        floor = np.maximum(floor, np.partition(lower, -k, axis=1)[:, -k])
    found, at = np.nonzero((near + margin >= floor[:, None]) & ~own)
    for first in range(0, len(found), 1 << 16):
        q, c = found[first : first + (1 << 16)], at[first : first + (1 << 16)]
        scores, ids = cosines(queries.vectors[q], rows.vectors[c]), rows.ids[c]
        # Many equal vectors survive the bounds together; only k of them can enter a heap.
        best = k_best(q, scores, ids, k)
        for query, score, candidate in zip(q[best].tolist(), scores[best].tolist(), ids[best].tolist()):
            heaps.push(query, score, candidate)


def _blocks(frame: pd.DataFrame) -> Iterator[Quantised]:
    for length, ids, vectors in zip(frame["length"], frame["ids"], frame["vectors"]):
        yield Quantised(
            np.frombuffer(ids, np.int64), np.frombuffer(vectors, np.float64).reshape(-1, length)
        )


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    stripe_bytes: int = STRIPE_BYTES,
) -> DataFrame:
    """The ``k`` nearest rows by cosine for every row that ``is_query`` marks.

    Returns ``query_id, rank, vec_id, score``.  Every other usable row of the same length is a
    candidate; a query with fewer candidates gets them all.  Rows without an id or a usable vector
    take no part.  Ties go to the smaller id.  Rows that repeat an id count once, with their best
    score.  An empty table gives an empty result; further columns are ignored.

    A tile holds about ``stripe_bytes`` of candidates and of queries (blocks are dealt to stripes by
    hash), so memory does not grow with the table.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(id_column).cast("long").alias("id"),
        F.col(vector_column).alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    ).filter(F.col("id").isNotNull() & usable(F.col("vector")))
    weight = F.sum(F.size("vector").cast("long") * 8)
    sizes = rows.groupBy("asks").agg(weight.alias("bytes")).collect()
    all_bytes = sum(r["bytes"] for r in sizes)
    asked_bytes = sum(r["bytes"] for r in sizes if r["asks"])
    cores = spark.sparkContext.defaultParallelism
    across = max(1, math.ceil(asked_bytes / stripe_bytes))
    down = max(2 * cores, math.ceil(all_bytes / stripe_bytes))

    def tiled(blocks: DataFrame, own: str, mine: int, other: str, theirs: int) -> DataFrame:
        """Give each block its stripe and a copy for every stripe of the other side."""
        stripe = F.pmod(F.xxhash64("source", "seq"), F.lit(mine)).cast("int")
        copies = F.explode(F.sequence(F.lit(0), F.lit(theirs - 1)))
        return blocks.withColumn(own, stripe).withColumn(other, copies)

    asked = tiled(pack(rows.filter("asks")), "across", across, "down", down)
    offered = tiled(pack(rows), "down", down, "across", across)

    def search(questions: pd.DataFrame, offers: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, float]] = []
        for queries in _blocks(questions):
            heaps = Heaps(len(queries.ids), k)
            for block in _blocks(offers):
                if block.codes.shape[1] == queries.codes.shape[1]:
                    search_tile(queries, block, heaps)
            for query, heap in zip(queries.ids.tolist(), heaps.heaps):
                out += [(query, -name, score) for score, name in heap]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = (
        asked.groupBy("across", "down")
        .cogroup(offered.groupBy("across", "down"))
        .applyInPandas(search, "query_id long, vec_id long, score double")
        .groupBy("query_id", "vec_id")
        .agg(F.max("score").alias("score"))
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
