"""Labelled text lines."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doctriage import fixed
from doctriage.functions.text import py_strip
from doctriage.operators.validation import is_sample
from doctriage.session import path_exists


def read_samples(
    spark: SparkSession, folder: str, labels: Mapping[str, str] = fixed.CORPUS_LABELS
) -> DataFrame:
    """``text, label`` from one file per label, one sample per line; missing files are skipped."""
    corpora = [
        spark.read.text(f"{folder}/{name}").select("value", F.lit(label).alias("label"))
        for name, label in labels.items()
        if path_exists(spark, f"{folder}/{name}")
    ]
    if not corpora:
        return spark.createDataFrame([], "text string, label string")
    return clean_samples(reduce(DataFrame.unionByName, corpora), "value")


def clean_samples(lines: DataFrame, text: str = "text") -> DataFrame:
    """Strip the lines and keep those long enough."""
    return lines.filter(is_sample(F.col(text))).select(py_strip(F.col(text)).alias("text"), "label")
