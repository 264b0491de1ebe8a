"""Hard negatives by Strassen products of integer tiles and mergeable heaps.

Vectors become whole numbers, ``floor(scale * x)``.  Anchor blocks and candidate blocks meet in
tiles, so a task holds one stripe of each.  A tile's scores are one exact integer product, formed by
Strassen's recursion on zero-padded quadrants.  Two rounds of tiles are needed, as the window of an
anchor's negatives follows from its positives: the first round fills one heap of positives per
anchor, the second one heap of negatives per anchor and positive.  A heap is a short sorted run, and
two of them merge into one: first over the blocks of a task, then over the tasks of an anchor.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doctriage.session import stage

BLOCK_BYTES = 1 << 20
BLOCK_ROWS = 2048
STRIPE_BYTES = 32 << 20
LEAF = 32
EXACT_DOUBLE, EXACT_LONG = 1 << 53, (1 << 63) - 1


@dataclass(frozen=True)
class Mining:
    """``positives`` per anchor and ``negatives`` per positive, in a window of the positive's score.

    A negative's score is at least ``low`` and at most ``high`` hundredths of the positive's.
    """

    scale: int = 256
    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95

    def window(self, score: int) -> tuple[int, int]:
        """The least and the largest whole score in the window; exact at any size."""
        return -(-self.low * score // 100), self.high * score // 100


def _product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The plain product; in double precision where no sum can leave its whole numbers."""
    if left.dtype == np.int64 and left.size and right.size:
        largest = max(abs(int(left.min())), abs(int(left.max()))) * max(abs(int(right.min())), abs(int(right.max())))
        if largest * left.shape[1] < EXACT_DOUBLE:
            return (left.astype(np.float64) @ right.astype(np.float64)).astype(np.int64)
    return left @ right


def _padded(matrix: np.ndarray, rows: int, columns: int) -> np.ndarray:
    if matrix.shape == (rows, columns):
        return matrix
    out = np.zeros((rows, columns), matrix.dtype)
    out[: matrix.shape[0], : matrix.shape[1]] = matrix
    return out


def strassen(left: np.ndarray, right: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``left @ right`` of whole numbers (int64, or Python's in object arrays) by seven products.

    Odd sides are padded with zeros.  Additions of int64 wrap around, which is harmless as long as
    the final sums fit: all of it is exact modulo 2^64.
    """
    (m, k), n = left.shape, right.shape[1]
    if min(m, k, n) <= leaf:
        return _product(left, right)
    p, q, r = (m + 1) // 2, (k + 1) // 2, (n + 1) // 2
    a, b = _padded(left, 2 * p, 2 * q), _padded(right, 2 * q, 2 * r)
    a11, a12, a21, a22 = a[:p, :q], a[:p, q:], a[p:, :q], a[p:, q:]
    b11, b12, b21, b22 = b[:q, :r], b[:q, r:], b[q:, :r], b[q:, r:]
    m1 = strassen(a11 + a22, b11 + b22, leaf)
    m2 = strassen(a21 + a22, b11, leaf)
    m3 = strassen(a11, b12 - b22, leaf)
    m4 = strassen(a22, b21 - b11, leaf)
    m5 = strassen(a11 + a12, b22, leaf)
    m6 = strassen(a21 - a11, b11 + b12, leaf)
    m7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * p, 2 * r), a.dtype)
    out[:p, :r] = m1 + m4 - m5 + m7
    out[:p, r:] = m3 + m5
    out[p:, :r] = m2 + m4
    out[p:, r:] = m1 - m2 + m3 + m6
    return out[:m, :n]


def whole_numbers(values: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)``: int64 where all fit with room to spare, else Python's whole numbers."""
    if not values.size or np.abs(values).max() * scale < 1 << 62:
        return np.floor(values * scale).astype(np.int64)
    exact = [math.floor(x * scale) if abs(x) < 1 << 52 else int(x) * scale for x in values.ravel().tolist()]
    return np.array(exact, dtype=object).reshape(values.shape)


class Block:
    """Rows of equal length in order of their ids."""

    def __init__(self, ids: bytes, labels: bytes, vectors: bytes, near: list, length: int, scale: int):
        self.near = near
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        values = np.frombuffer(vectors, np.float64).reshape(len(self.ids), length)
        self.codes = whole_numbers(values, scale)
        self.length = length
        self.largest = int(np.abs(self.codes).max()) if self.codes.size else 0


def scores(anchors: Block, rows: Block) -> np.ndarray:
    """Exact inner products; Python's whole numbers where a sum might leave int64."""
    left, right = anchors.codes, rows.codes
    if not anchors.length:
        return np.zeros((len(left), len(right)), np.int64)
    if anchors.length * anchors.largest * rows.largest > EXACT_LONG:
        left, right = left.astype(object), right.astype(object)
    return strassen(left, right.T)


def first_of(values: np.ndarray, eligible: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each of ``k`` places, the rows that have an eligible entry left and its column.

    Larger values come first, ties by the smaller column.
    """
    left = eligible.copy()
    if values.dtype == object:
        lowest = min((v for row in values for v in row), default=0) - 1
    else:
        lowest = np.iinfo(np.int64).min
    shown = np.where(left, values, lowest)
    for _ in range(min(k, values.shape[1])):
        rows = np.flatnonzero(left.any(axis=1))
        if not len(rows):
            return
        best = shown[rows].argmax(axis=1)
        if values.dtype != object:  # an eligible entry may itself be the lowest number
            odd = ~left[rows, best]
            best[odd] = left[rows[odd]].argmax(axis=1)
        yield rows, best
        left[rows, best] = False
        shown[rows, best] = lowest


class Heap:
    """The ``k`` best ``(score, id)`` of a stream; heaps of parts of it merge into its heap."""

    __slots__ = ("k", "items")

    def __init__(self, k: int, items: list[tuple[int, int]] = ()):
        self.k, self.items = k, list(items)

    def merge(self, others: list[tuple[int, int]]) -> None:
        self.items = sorted(self.items + others, key=lambda x: (-x[0], x[1]))[: self.k]


def _encoded(items: list[tuple[int, int]]) -> list[dict]:
    """Scores as decimal text: they are exact even beyond a long."""
    return [{"score": str(score), "id": name} for score, name in items]


HEAP = "array<struct<score: string, id: long>>"
BLOCK_SCHEMA = "source int, seq int, length int, ids binary, labels binary, vectors binary, near array<array<string>>"


def pack(rows: DataFrame) -> DataFrame:
    """``id, label, vector`` as blocks of bounded rows and bytes, in order of the ids, in place.

    ``near``, if the rows have it, holds the scores of an anchor's positives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        source, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, labels = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            lengths = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            values = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
            for length in np.unique(lengths):
                own = np.flatnonzero(lengths == length)
                size = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(1, int(length)))))
                for at in range(0, len(own), size):
                    part = own[at : at + size]
                    part = part[np.argsort(ids[part], kind="stable")]
                    block = values[starts[part][:, None] + np.arange(length)]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "source": pa.array([source], pa.int32()),
                            "seq": pa.array([seq], pa.int32()),
                            "length": pa.array([int(length)], pa.int32()),
                            "ids": [ids[part].tobytes()],
                            "labels": [labels[part].tobytes()],
                            "vectors": [block.astype(np.float64).tobytes()],
                            "near": pa.array([batch.column(3).take(pa.array(part)).to_pylist()], pa.list_(pa.list_(pa.string()))),
                        }
                    )
                    seq += 1

    near = F.col("near") if "near" in rows.columns else F.lit(None).cast("array<string>")
    return rows.select(
        "id", F.col("label").cast("long"), F.col("vector").cast("array<double>"), near.alias("near")
    ).mapInArrow(run, BLOCK_SCHEMA)


def usable(rows: DataFrame) -> DataFrame:
    """``id, label, vector, asks``: the rows that take part, one for each id."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))
    whole = F.coalesce(F.forall("vector", number), F.lit(False))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & whole)
    least = F.min(F.struct("label", "vector", "asks")).alias("row")
    return rows.groupBy("id").agg(least).select("id", "row.*")


def _dealt(blocks: DataFrame, own: str, mine: int, other: str, theirs: int) -> DataFrame:
    """Blocks in turn over the stripes of their side, with a copy for every stripe of the other."""
    stripe = F.pmod(F.col("seq") + F.col("source") * 7919, F.lit(mine)).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.lit(theirs - 1)))
    return blocks.withColumn(own, stripe).withColumn(other, copies)


def _merged(heaps: DataFrame, keys: list[str], k: int) -> DataFrame:
    """One heap for each key from the heaps of all tiles.

    Heaps arrive in order of their keys and merge one by one, so a task holds one heap at a time.
    """
    kinds = {name: heaps.schema[name].dataType.simpleString() for name in keys}
    schema = ", ".join(f"{name} {kind}" for name, kind in kinds.items()) + f", heap {HEAP}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, heap, done = None, Heap(k), []
        for batch in batches:
            for row in batch.to_pylist():
                key = tuple(row[name] for name in keys)
                if key != now:
                    if now is not None:
                        done.append(dict(zip(keys, now)) | {"heap": _encoded(heap.items)})
                    now, heap = key, Heap(k)
                heap.merge([(int(x["score"]), x["id"]) for x in row["heap"]])
            if done:
                yield pa.RecordBatch.from_pylist(done, out)
                done = []
        if now is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(keys, now)) | {"heap": _encoded(heap.items)}], out)

    item = pa.struct([("score", pa.string()), ("id", pa.int64())])
    arrow = {"bigint": pa.int64(), "int": pa.int32()}
    out = pa.schema([*((name, arrow[kind]) for name, kind in kinds.items()), ("heap", pa.list_(item))])
    ordered = heaps.repartition(*keys).sortWithinPartitions(*keys)
    return ordered.select(*keys, "heap").mapInArrow(run, schema)


def _blocks(frame: pd.DataFrame, scale: int) -> Iterator[Block]:
    for row in frame.itertuples(index=False):
        yield Block(row.ids, row.labels, row.vectors, row.near, row.length, scale)


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    mining: Mining = Mining(),
    id_column: str = "vec_id",
    label: Column | str = "label",
    vector_column: str = "embedding",
    stripe_bytes: int = STRIPE_BYTES,
) -> DataFrame:
    """Hard negatives of every anchor and positive:
    ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    A score is the inner product of the whole-number vectors; larger ones come first, ties by the
    smaller id.  Positives are the first other rows of the anchor's label, negatives the first rows
    of other labels whose score lies in the window of the positive's; fewer where there are fewer,
    and no row for a positive without any.

    Rows with a null id, label or vector, or a component that is null or not finite take no part.
    Only vectors of equal length are compared; empty ones score 0.  An id that several rows repeat
    counts once, by its smallest (label, vector).  A score beyond a long is ranked exactly and shown
    as null.  An empty table gives an empty result; further columns are ignored.

    A tile holds ``stripe_bytes`` of anchors and as much of candidates, apart from one block.
    """
    spark = vectors.sparkSession
    label = F.col(label) if isinstance(label, str) else label
    rows = stage(
        usable(
            vectors.select(
                F.col(id_column).cast("long").alias("id"),
                label.cast("long").alias("label"),
                F.col(vector_column).cast("array<double>").alias("vector"),
                F.coalesce(is_anchor, F.lit(False)).alias("asks"),
            )
        ),
        "minable",
    )
    weight = F.coalesce(F.sum(F.size("vector").cast("long") * 8 + 16), F.lit(0))
    asked_bytes = rows.filter("asks").agg(weight).first()[0]
    all_bytes = rows.agg(weight).first()[0]
    across = max(1, math.ceil(asked_bytes / stripe_bytes))
    down = max(2 * spark.sparkContext.defaultParallelism, math.ceil(all_bytes / stripe_bytes))
    asking = rows.filter("asks")
    asked = _dealt(pack(asking), "across", across, "down", down).groupBy("across", "down")
    offered = _dealt(pack(rows), "down", down, "across", across).groupBy("across", "down")

    def positives(questions: pd.DataFrame, offers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for anchors in _blocks(questions, mining.scale):
            heaps = [Heap(mining.positives) for _ in anchors.ids]
            for block in _blocks(offers, mining.scale):
                if block.length == anchors.length:
                    fits = (anchors.labels[:, None] == block.labels) & (anchors.ids[:, None] != block.ids)
                    found = scores(anchors, block)
                    for at, best in first_of(found, fits, mining.positives):
                        for a, c in zip(at.tolist(), best.tolist()):
                            heaps[a].merge([(int(found[a, c]), int(block.ids[c]))])
            out += [(name, _encoded(heap.items)) for name, heap in zip(anchors.ids.tolist(), heaps) if heap.items]
        return pd.DataFrame(out, columns=["anchor_id", "heap"])

    near = _merged(asked.cogroup(offered).applyInPandas(positives, f"anchor_id long, heap {HEAP}"), ["anchor_id"], mining.positives)
    near = stage(near, "positives")

    def negatives(questions: pd.DataFrame, offers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for anchors in _blocks(questions, mining.scale):
            windows = [[mining.window(int(score)) for score in own] for own in anchors.near]
            heaps = [[Heap(mining.negatives) for _ in own] for own in windows]
            for block in _blocks(offers, mining.scale):
                if block.length != anchors.length:
                    continue
                found = scores(anchors, block)
                other = anchors.labels[:, None] != block.labels
                for place in range(mining.positives):
                    asks = np.array([a for a, own in enumerate(windows) if place < len(own)], np.int64)
                    if not len(asks):
                        break
                    low, high = _bounds([windows[a][place] for a in asks], found.dtype)
                    part = found[asks]
                    fits = other[asks] & (part >= low[:, None]) & (part <= high[:, None])
                    for at, best in first_of(part, fits, mining.negatives):
                        for a, c in zip(at.tolist(), best.tolist()):
                            heaps[asks[a]][place].merge([(int(part[a, c]), int(block.ids[c]))])
            for name, own in zip(anchors.ids.tolist(), heaps):
                out += [(name, place, _encoded(h.items)) for place, h in enumerate(own) if h.items]
        return pd.DataFrame(out, columns=["anchor_id", "place", "heap"])

    # The second round's anchors carry the scores of their positives.
    known = asking.join(near.select(F.col("anchor_id").alias("id"), F.col("heap.score").alias("near")), "id")
    asked = _dealt(pack(known), "across", across, "down", down).groupBy("across", "down")
    far = asked.cogroup(offered).applyInPandas(negatives, f"anchor_id long, place int, heap {HEAP}")
    far = _merged(far, ["anchor_id", "place"], mining.negatives)

    of = near.select("anchor_id", F.posexplode("heap").alias("place", "positive"))
    ranked = far.select("anchor_id", "place", F.posexplode("heap").alias("at", "negative"))
    return ranked.join(of, ["anchor_id", "place"]).select(
        "anchor_id",
        F.col("positive.id").alias("positive_id"),
        (F.col("at") + 1).cast("int").alias("rank"),
        F.col("negative.id").alias("negative_id"),
        F.col("positive.score").try_cast("long").alias("positive_score"),
        F.col("negative.score").try_cast("long").alias("negative_score"),
    )


def _bounds(windows: list[tuple[int, int]], dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Both ends of windows as numbers that compare with scores of ``dtype``."""
    if dtype == object:
        low, high = zip(*windows)
        return np.array(low, dtype=object), np.array(high, dtype=object)
    least, most = -EXACT_LONG - 1, EXACT_LONG
    # A window wholly outside of a long holds none of these scores.
    held = [(max(least, a), min(most, b)) if a <= most and b >= least else (most, least) for a, b in windows]
    return np.array([a for a, _ in held], np.int64), np.array([b for _, b in held], np.int64)
