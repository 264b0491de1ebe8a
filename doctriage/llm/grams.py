"""Hashed character n-grams and their document frequencies, for the classifiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 20  # code points handled at once
FOLDS = 5

Counter = Callable[[str], np.ndarray]


def fold(doc_id: Column) -> Column:
    """crc32 of the id's decimal text modulo ``FOLDS``; null without an id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


@lru_cache(1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def code_points(text: str) -> Iterator[np.ndarray]:
    for at in range(0, len(text), CHUNK):
        yield np.frombuffer(text[at : at + CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)


def count_grams(points: np.ndarray, orders: int, buckets: int, before: int = 0) -> np.ndarray:
    """Counts of the 1- to ``orders``-grams of ``points``, hashed to a power of two of buckets.

    The first ``before`` points were counted with the chunk they end; n-grams inside of them are not
    counted again."""
    total = np.zeros(buckets, np.int64)
    shift = np.uint32(32 - (buckets.bit_length() - 1))
    own = points.astype(np.uint32)
    hashed = np.zeros(len(own), np.uint32)
    for order in range(1, orders + 1):
        if len(own) < order:
            break
        hashed = hashed[: len(own) - order + 1] * np.uint32(0x01000193) + own[order - 1 :] + np.uint32(order)
        mixed = (hashed ^ (hashed >> np.uint32(15))) * np.uint32(0x9E3779B1)
        total += np.bincount(mixed[max(0, before - order + 1) :] >> shift, minlength=buckets)
    return total


def document_frequencies(texts: DataFrame, counter: Counter, size: int) -> tuple[np.ndarray, int]:
    """In how many documents of ``texts`` (``text``) each of ``size`` terms occurs, and how many
    documents there are.  Each task adds up its own documents, so ``size`` rows leave it at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size + 1, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen[:size] += counter(text or "") > 0
                seen[size] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"term": pa.array(at, pa.int64()), "n": pa.array(seen[at])})

    rows = texts.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = np.zeros(size + 1, np.int64)
    for row in rows.collect():  # size + 1 rows at most
        found[row["term"]] = row["n"]
    return found[:size], int(found[size])


def inverse_frequencies(frequencies: np.ndarray, documents: int) -> np.ndarray:
    return (np.log((1 + documents) / (1 + frequencies)) + 1).astype(np.float32)


def weights(
    counts: np.ndarray, inverse: np.ndarray, damp: Callable = np.log1p
) -> tuple[np.ndarray, np.ndarray]:
    """Non-zero terms and their TF-IDF weights (``damp`` of the counts) as a vector of length one."""
    terms = np.flatnonzero(counts)
    values = damp(counts[terms]).astype(np.float32) * inverse[terms]
    length = float(np.sqrt((values * values).sum()))
    return terms, values / np.float32(length) if length else values
