"""Append-only report log and the latest-state log keyed by file name."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from doctriage import fixed
from doctriage.operators.reports import log_lines
from doctriage.session import child_names, delete_path, path_exists

MERGE_RUNS = 8


def append_log(report: DataFrame, path: str) -> None:
    report.write.mode("append").parquet(path)


def write_log_text(report: DataFrame, path: str) -> None:
    """The log as text files in order of the reports; one file per range of reports."""
    log_lines(report).orderBy("seq").select("entry").write.mode("append").text(path, lineSep="")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log as ``seq, entry`` in order, or one row saying there is none yet.

    The entries stay rows: one string over the whole log would have to fit in one task.
    """
    if not path_exists(spark, path):
        return log_or_notice(spark.createDataFrame([], "seq long, entry string"))
    return log_or_notice(log_lines(spark.read.parquet(path)))


def log_or_notice(entries: DataFrame) -> DataFrame:
    notice = entries.limit(1).agg(F.count("*").alias("n")).filter("n = 0")
    return entries.unionByName(
        notice.select(F.lit(0).cast("long").alias("seq"), F.lit(fixed.NO_LOGS).alias("entry"))
    )


def latest_per_key(items: DataFrame, key: str | list[str], order: str | Column) -> DataFrame:
    """Last write wins.  Each task keeps one row per key before the shuffle (a window that only
    numbers rows and keeps the first becomes a limit per group), so a key with many writes sends few."""
    keys = [key] if isinstance(key, str) else list(key)
    newest = Window.partitionBy(*keys).orderBy((order if isinstance(order, Column) else F.col(order)).desc_nulls_last())
    return items.withColumn("_place", F.row_number().over(newest)).filter("_place = 1").drop("_place")


# ---- a keyed log in merged tiers ---------------------------------------------------------
#
# ``path/tier=<n>/run=<first>[..<last>]`` holds one put (tier 0) or the merged state of several
# adjoining runs of the tier below.  A read takes the latest row per key of all runs, so a row that
# two runs hold, as between a merge and the deletion of what it merged, changes nothing.


def whole_runs(spark: SparkSession, path: str) -> dict[int, list[str]]:
    """Names of the whole runs of each tier, in order; ``MERGE_RUNS`` or so for each of few tiers."""
    tiers = sorted(int(name.removeprefix("tier=")) for name in child_names(spark, path) if name.startswith("tier="))
    whole = lambda tier, name: path_exists(spark, f"{path}/tier={tier}/{name}/_SUCCESS")
    return {tier: sorted(n for n in child_names(spark, f"{path}/tier={tier}") if whole(tier, n)) for tier in tiers}


def _ends(name: str) -> tuple[str, str]:
    first, _, last = name.removeprefix("run=").partition("..")
    return first, last or first


def has_run(spark: SparkSession, path: str, run: str) -> bool:
    return path_exists(spark, f"{path}/tier=0/{run}/_SUCCESS")


def put_items(
    items: DataFrame, path: str, run: str | None = None, key: str = "filename", order: str = "seq", fan: int = MERGE_RUNS
) -> None:
    """Add items to the log at ``path``; a ``run`` that is put again replaces itself.

    Names of runs start with their time.  After ``fan`` runs of a tier they are merged into one of the
    next, so a row is rewritten once per tier and the number of files stays bounded."""
    run = run or f"run={time.time_ns() // 1000:016d}-{uuid.uuid4().hex}"
    items.write.mode("overwrite").parquet(f"{path}/tier=0/{run}")
    merge_items(items.sparkSession, path, key, order, fan)


def merge_items(spark: SparkSession, path: str, key: str = "filename", order: str = "seq", fan: int = MERGE_RUNS) -> None:
    """Merge every tier that has ``fan`` runs."""

    def merge(folders: list[str], target: str) -> None:
        latest_per_key(spark.read.parquet(*folders), key, order).write.mode("overwrite").parquet(target)

    merge_tiers(spark, path, merge, fan)


def merge_tiers(spark: SparkSession, path: str, merge: Callable[[list[str], str], None], fan: int = MERGE_RUNS) -> None:
    """Have ``merge`` write the runs of every tier that has ``fan`` of them as one run of the next.

    What a merge replaces is deleted by the next one, when readers that began before it are done; a
    merge that was stopped is simply made again."""
    tier = 0
    while True:
        runs = whole_runs(spark, path)
        above = [_ends(name) for name in runs.get(tier + 1, [])]
        covered = [n for n in runs.get(tier, []) if any(a <= _ends(n)[0] and _ends(n)[1] <= b for a, b in above)]
        single = [n for n in runs.get(tier, []) if n not in covered]
        if len(single) < fan:
            if tier >= max(runs, default=0):
                return
            tier += 1
            continue
        for name in covered:
            delete_path(spark, f"{path}/tier={tier}/{name}")
        ends = f"run={_ends(single[0])[0]}..{_ends(single[-1])[1]}"
        merge([f"{path}/tier={tier}/{name}" for name in single], f"{path}/tier={tier + 1}/{ends}")
        tier += 1


def _read(spark: SparkSession, path: str, runs: list[tuple[int, str]]) -> DataFrame:
    """The rows of some runs."""
    return spark.read.parquet(*[f"{path}/tier={tier}/{name}" for tier, name in runs])


def read_items(spark: SparkSession, path: str, key: str = "filename", order: str = "seq") -> DataFrame:
    """The latest item of each key, from all runs of all tiers."""
    runs = [(tier, name) for tier, names in whole_runs(spark, path).items() for name in names]
    return latest_per_key(_read(spark, path, runs), key, order)


def compact_items(spark: SparkSession, path: str, key: str = "filename", order: str = "seq") -> None:
    """Merge all runs into one of the highest tier, which later reads take instead of them."""
    runs = whole_runs(spark, path)
    every = [(tier, name) for tier, names in runs.items() for name in names]
    if len(every) < 2:
        return
    first, last = min(_ends(n)[0] for _, n in every), max(_ends(n)[1] for _, n in every)
    top = f"{path}/tier={max(runs) + 1}/run={first}..{last}"
    latest_per_key(_read(spark, path, every), key, order).write.mode("overwrite").parquet(top)
    for tier, name in every:
        delete_path(spark, f"{path}/tier={tier}/{name}")
