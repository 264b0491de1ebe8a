"""From raw documents to a training mixture: each stage reads what its predecessor has written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from doctriage.llm import language, mixing, near_duplicates, personal_data, templates
from doctriage.llm.text_queries import MIXTURE_SHARE, mixture
from doctriage.session import shared_folder


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents in which no language is found."""
    return language.keep_identified(docs)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return near_duplicates.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a benchmark item."""
    return templates.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), templates.WHOLE)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With personal data in the texts replaced by its kind."""
    return personal_data.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents selected for the target weights, once per epoch."""
    return mixing.mix(docs, mixture(), MIXTURE_SHARE)


STAGES = [
    ("language", identified),
    ("near duplicates", deduplicated),
    ("decontamination", decontaminated),
    ("personal data", redacted),
    ("mixture", mixed),
]

# A trained classifier and similarity groups have no SQL counterpart.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table; each result is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for at, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{at}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
