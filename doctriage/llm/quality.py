"""Quality scores by votes of the nearest labelled documents in a latent space.

A text is described by how it looks: n-grams of its shape (letters, digits and blanks by class,
other characters as they are) and how often its words repeat.  TF-IDF vectors of a bounded
labelled sample span the latent space.  The labelled vectors are broadcast; every document's
cosines to all of them are computed in blocks, and its nearest neighbours vote with their
similarity as weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doctriage.llm import grams

ORDERS, BUCKETS = 4, 1 << 11
REPEATS = 3  # terms for repeated words, after the n-gram buckets
SIZE = BUCKETS + REPEATS
BLOCK = 256
THRESHOLD = 0.3


@dataclass(frozen=True)
class Voting:
    """``labelled`` bounds the labelled documents that are broadcast (``labelled`` x ``dimensions``
    single-precision numbers); ``neighbours`` of them vote on a document."""

    labelled: int = 4096
    dimensions: int = 48
    neighbours: int = 25
    seed: int = 7


@dataclass(frozen=True)
class Model:
    inverse: np.ndarray
    axes: np.ndarray  # terms x dimensions
    vectors: np.ndarray  # labelled x dimensions, of length one or zero
    labels: np.ndarray
    neighbours: int
    prior: float

    def place(self, texts: list[str]) -> np.ndarray:
        return place(texts, self.inverse, self.axes)

    def scores(self, texts: list[str]) -> np.ndarray:
        """Votes for label 1; the share of label 1 where no labelled document is similar."""
        near = self.place(texts) @ self.vectors.T
        k = min(self.neighbours, near.shape[1])
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        power = np.maximum(np.take_along_axis(near, best, axis=1), 0).astype(np.float64)
        total = power.sum(axis=1)
        votes = (power * self.labels[best]).sum(axis=1)
        return np.clip(np.where(total > 1e-9, votes / np.maximum(total, 1e-9), self.prior), 0, 1)


@lru_cache(1)
def shapes() -> np.ndarray:
    """The class of each code point: a, A, 0, blank, line end, or the code point itself."""

    def shape(c: int) -> int:
        own = chr(c)
        if own.isalpha():
            return ord("A") if own.isupper() else ord("a")
        if own.isdigit():
            return ord("0")
        return c if own == "\n" or not own.isspace() else ord(" ")

    return np.fromiter(map(shape, range(0x110000)), np.uint32, 0x110000)


def look(text: str) -> np.ndarray:
    """Counts of the shape n-grams of ``text`` and of its repeated words."""
    total = np.zeros(SIZE, np.int64)
    tail = np.zeros(0, np.uint32)
    for points in grams.code_points(text):
        own = np.concatenate([tail, shapes()[points]])
        total[:BUCKETS] += grams.count_grams(own, ORDERS, BUCKETS, len(tail))
        tail = own[max(0, len(own) - ORDERS + 1) :]
    words = text.split()
    total[BUCKETS] = sum(map(eq, words, words[1:]))
    total[BUCKETS + 1] = sum(map(eq, words, words[2:]))
    total[BUCKETS + 2] = len(words) - len(set(words))
    return total


def place(texts: list[str], inverse: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Latent vectors of length one; zero for an empty text."""
    out = np.zeros((len(texts), axes.shape[1]), np.float32)
    for at, text in enumerate(texts):
        terms, values = grams.weights(look(text), inverse)
        if len(terms):
            out[at] = values @ axes[terms]
    return unit(out)


def unit(rows: np.ndarray) -> np.ndarray:
    lengths = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(lengths > 1e-12, lengths, 1)


def principal_axes(rows: np.ndarray, dimensions: int, seed: int) -> np.ndarray:
    """The leading right singular vectors of ``rows`` by subspace iteration."""
    random = np.random.default_rng(seed)
    basis = random.normal(size=(rows.shape[1], min(dimensions + 10, *rows.shape))).astype(np.float32)
    for _ in range(6):
        basis, _ = np.linalg.qr(rows.T @ (rows @ basis))
    _, _, turn = np.linalg.svd(rows @ basis, full_matrices=False)
    return (basis @ turn.T)[:, :dimensions].astype(np.float32)


def learn(documents: DataFrame, labels: DataFrame, how: Voting = Voting()) -> Model | None:
    """Fit on labelled documents outside fold 0; None without any.

    ``labels`` has ``doc_id, quality``; an id labelled several times votes with the mean, one with
    several texts by the text of least hash, and one without a document takes no place in the sample.
    Document frequencies cover all documents.
    """
    fold = grams.fold(F.col("doc_id"))
    chosen = (
        labels.filter((fold != 0) & F.col("quality").isNotNull())
        .join(documents.select("doc_id"), "doc_id", "left_semi")
        .groupBy(F.col("doc_id").alias("id"))
        .agg(F.avg("quality").alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(how.labelled)
    )
    frequencies, total = grams.document_frequencies(documents, look, SIZE)
    inverse = grams.inverse_frequencies(frequencies, total)
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(chosen), F.col("id") == F.col("doc_id")).drop("doc_id")
    one = F.min(F.struct(F.xxhash64("text").alias("print"), "text")).alias("one")
    rows = rows.groupBy("id", "label").agg(one).select("id", "label", "one.text")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dense = []
            for text in batch.column(2).to_pylist():
                row = np.zeros(SIZE, np.float32)
                terms, values = grams.weights(look(text), inverse)
                row[terms] = values
                dense.append(row.tobytes())
            yield pa.RecordBatch.from_pydict(
                {"id": batch.column(0), "label": batch.column(1), "row": pa.array(dense, pa.binary())}
            )

    def span(sample: pd.DataFrame) -> pd.DataFrame:
        sample = sample.sort_values("id")
        own = np.frombuffer(b"".join(sample["row"]), np.float32).reshape(-1, SIZE)
        axes = principal_axes(own, how.dimensions, how.seed)
        placed = unit(own @ axes)
        votes = sample["label"].to_numpy(np.float64)
        return pd.DataFrame(
            {"axes": [axes.tobytes()], "vectors": [placed.tobytes()], "labels": [votes.tobytes()]}
        )

    fitted = (
        rows.mapInArrow(vectors, "id long, label double, row binary")
        .withColumn("whole", F.lit(0))
        .groupBy("whole")  # the bounded sample
        .applyInPandas(span, "axes binary, vectors binary, labels binary")
        .collect()
    )
    if not fitted:
        return None
    axes = np.frombuffer(fitted[0]["axes"], np.float32).reshape(SIZE, -1)
    votes = np.frombuffer(fitted[0]["labels"], np.float64)
    vectors_ = np.frombuffer(fitted[0]["vectors"], np.float32).reshape(len(votes), -1)
    return Model(inverse, axes, vectors_, votes, how.neighbours, float(votes.mean()))


def score(documents: DataFrame, labels: DataFrame, how: Voting = Voting()) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``documents``.

    The score is the neighbours' weighted share of label 1, from the whole text alone.  Null and
    empty texts get the share of label 1 in the sample, as nothing is similar to them; without any
    label to learn from, all get 0.5.  A null id is neither learned from nor held out.  Repeated
    rows are scored alike; further columns are ignored.
    """
    shared = documents.sparkSession.sparkContext.broadcast(learn(documents, labels, how))

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        model, out = shared.value, []
        for at in range(0, len(texts), BLOCK):
            block = [t or "" for t in texts.iloc[at : at + BLOCK]]
            out.append(np.full(len(block), 0.5) if model is None else model.scores(block))
        return pd.Series(np.concatenate(out) if out else [], dtype=float)

    held = F.coalesce(grams.fold(F.col("doc_id")) == 0, F.lit(False))
    return documents.select(
        "doc_id", held.alias("held_out"), run(F.col("text")).alias("score")
    ).withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
