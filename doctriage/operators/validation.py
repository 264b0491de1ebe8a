"""File checks: presence, size, type and the sample and threshold predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from doctriage import fixed
from doctriage.functions.text import py_strip


def check_file(length: Column, large_bytes: int = fixed.LARGE_FILE_BYTES) -> Column:
    """``struct<status, reason>`` for a file; null length means the file is missing."""

    def verdict(pair: tuple[str, str]) -> Column:
        return F.struct(F.lit(pair[0]).alias("status"), F.lit(pair[1]).alias("reason"))

    return (
        F.when(length.isNull(), verdict(fixed.CHECK_MISSING))
        .when(length == 0, verdict(fixed.CHECK_EMPTY))
        .when(length > large_bytes, verdict(fixed.CHECK_LARGE))
        .otherwise(verdict(fixed.CHECK_OK))
    )


def is_non_document(ext: Column) -> Column:
    return ext.isin(*fixed.NON_DOCUMENT_TYPES)


def is_confident(confidence: Column, threshold: float = fixed.CONFIDENCE_THRESHOLD) -> Column:
    """Tested on the unrounded confidence."""
    return confidence >= F.lit(threshold)


def is_sample(text: Column, min_chars: int = fixed.MIN_SAMPLE_CHARS) -> Column:
    """Labelled lines count when their stripped length exceeds ``min_chars``."""
    return F.length(py_strip(text)) > min_chars


def enough_samples(count: Column, minimum: int = fixed.MIN_SAMPLES) -> Column:
    """Whether so many samples suffice for training."""
    return count >= minimum


def require_samples(count: int, minimum: int = fixed.MIN_SAMPLES) -> None:
    if count < minimum:
        raise ValueError(f"not enough data to train: {count} samples, need {minimum}")
