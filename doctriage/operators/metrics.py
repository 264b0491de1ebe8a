"""Counters, summaries and bar scaling; each is one partial aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doctriage import fixed

# Counter a document type adds to, in the order counters are tried.
TYPE_COUNTERS = {label: f"{label.lower()}s" for label in fixed.LABELS}


def counter_bucket(document_type: Column, status: Column) -> Column:
    """First match wins: type in any case, then duplicate, else failed."""
    lowered = F.lower(F.coalesce(document_type, F.lit("")))
    chain = F
    for label, counter in TYPE_COUNTERS.items():
        chain = chain.when(lowered == label.lower(), F.lit(counter))
    return chain.when(status == "duplicate", F.lit("duplicates")).otherwise(F.lit("failed"))


def _counter_sums() -> list[Column]:
    names = [*TYPE_COUNTERS.values(), "duplicates", "failed"]
    return [F.count("*").alias("total"), *[F.count_if(F.col("bucket") == name).alias(name) for name in names]]


def _summary_sums() -> list[Column]:
    success = F.count_if(F.col("status") == "success")
    return [F.count("*").alias("total"), success.alias("success"), (F.count("*") - success).alias("failed")]


def _bucketed(records: DataFrame) -> DataFrame:
    return records.select(counter_bucket(F.col("document_type"), F.col("status")).alias("bucket"), "status")


def counters(records: DataFrame) -> DataFrame:
    """One row: ``total`` and one column per counter."""
    return _bucketed(records).agg(*_counter_sums())


def batch_summary(records: DataFrame) -> DataFrame:
    return records.agg(*_summary_sums())


def totals(records: DataFrame) -> DataFrame:
    """Both of the above as the structs ``counters`` and ``batch`` of one row; rows add up by field."""
    return _bucketed(records).agg(
        F.struct(*_counter_sums()).alias("counters"), F.struct(*_summary_sums()).alias("batch")
    )


def label_totals(samples: DataFrame) -> DataFrame:
    """Samples per label, and their total under ``(all)``."""
    return (
        samples.rollup("label")
        .agg(F.count("*").alias("samples"))
        .select(F.coalesce("label", F.lit("(all)")).alias("label"), "samples")
    )


def bars(totals: DataFrame, names: tuple[str, ...] = tuple(TYPE_COUNTERS.values())) -> DataFrame:
    """Width in percent of the largest of the named counters, from the one-row ``counters``."""
    highest = F.greatest(*[F.col(name) for name in names], F.lit(1))
    cells = [F.struct(F.lit(n).alias("name"), F.col(n).alias("count")) for n in names]
    return totals.select(highest.alias("highest"), F.inline(F.array(*cells))).select(
        "name", "count", (F.col("count") / F.col("highest") * 100).alias("width")
    )
