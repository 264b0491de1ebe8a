"""Keyed state in hash buckets, so that a run opens the buckets of its keys and no others.

``path/tier=<n>/run=<first>[..<last>]/bucket=<b>`` holds the rows that one run added (tier 0) or the
merged rows of several adjoining runs of the tier below.  A key is in the same bucket in every run.
Rows are facts that stay true, so a row that two runs hold, or that a repeated run adds again,
changes nothing; readers take the largest value per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doctriage.session import child_names, empty
from doctriage.sinks.logs import MERGE_RUNS, has_run, merge_tiers, whole_runs

BUCKETS = 128


def bucket(*key: Column) -> Column:
    """The bucket of a key; part of the layout, so it must not change for stored state."""
    return F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).cast("int")


def put_state(rows: DataFrame, path: str, run: str, key: Sequence[str], value: str | None, fan: int = MERGE_RUNS) -> None:
    """Add the rows of a run, with their ``bucket``; a run that was put already is left as it is.

    One row per key is kept, with the largest ``value``.  After ``fan`` runs of a tier they are merged
    into one of the next: a row is rewritten once per tier, and a bucket has few files."""
    spark = rows.sparkSession

    def write(rows: DataFrame, target: str) -> None:
        kept = rows.groupBy("bucket", *key).agg(F.max(value).alias(value)) if value else rows.distinct()
        kept.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(target)

    def merge(folders: list[str], target: str) -> None:
        fields = "bucket int, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "bucket")
        parts = [spark.read.schema(fields).parquet(folder) for folder in folders]
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        write(whole, target)

    if not has_run(spark, path, run):
        write(rows, f"{path}/tier=0/{run}")
    merge_tiers(spark, path, merge, fan)


def read_state(spark: SparkSession, path: str, schema: str, wanted: DataFrame) -> DataFrame:
    """All rows of the buckets that ``wanted`` names in its column ``bucket``, at most ``BUCKETS`` of
    them.  Rows may repeat keys; other keys of the same buckets are among them."""
    names = {f"bucket={row['bucket']}" for row in wanted.select("bucket").distinct().collect()}
    paths = []
    for tier, runs in whole_runs(spark, path).items():
        for run in runs:
            folder = f"{path}/tier={tier}/{run}"
            held = {child for child in child_names(spark, folder) if child.startswith("bucket=")}
            paths += [folder] if held and held <= names else [f"{folder}/{name}" for name in sorted(held & names)]
    if not paths:
        return empty(spark, schema)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*paths)


def has_state(spark: SparkSession, path: str) -> bool:
    return any(whole_runs(spark, path).values())
