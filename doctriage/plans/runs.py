"""Runs that keep their state under one root folder: results, sorted files and the log.

``root/results/run=<id>`` holds one row per file and run, ``root/totals/run=<id>`` the counts of a
run, and ``root/documents`` the copied files.  The log is made from the results.  Ids of runs start with the
time, so ``(run, arrival_seq)`` orders all results.

What a run must know of the past stands in ``root/state``, in hash buckets: the files that were handled
(by path), the contents that were registered (by fingerprint) and the names that were given (by family
of names).  A run opens the buckets of the files it finds, so its cost follows them and not the
history.  Every run adds its own rows before it is closed; they follow from its results.

``root/journal/run=<id>`` is there while a run is open.  The plan (what each file is, where it goes and
how it is called) is written there before the first copy; the journal is deleted after the results
are whole.  The next run first finishes what it finds open: without a whole plan nothing was copied
and the files are new again; with one, the copies are redone from the plan, which leaves those that
are there as they are, and the results are written again.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import DoubleType, StringType, StructField, StructType, TimestampType

from doctriage import fixed
from doctriage.operators import metrics
from doctriage.operators.naming import name_family, name_state
from doctriage.operators.reports import log_lines, recent_results, report_rows
from doctriage.plans.local import RESULT_SCHEMA, Settings, triage_folder, verified
from doctriage.session import child_names, delete_path, empty, job_stages, path_exists, stage
from doctriage.sinks.files import copy_files, folder_listing, held_files
from doctriage.sinks.logs import log_or_notice
from doctriage.sinks.state import bucket, has_state, put_state, read_state
from doctriage.sources.files import list_folder

# Key, value that is kept per key, and columns of each kind of state.
STATE = {
    "handled": (("path", "modificationTime", "length"), None, "path string, modificationTime timestamp, length long"),
    "registry": (("md5",), None, "md5 string"),
    "names": (("destination", "file_name"), "last", "destination string, file_name string, last long"),
}
LOOK_UPS = 3  # rounds of looking planned names up before the folders are listed


def open_runs(spark: SparkSession, root: str) -> list[str]:
    """Names of the runs that were begun and not closed; one at most, unless journals were copied."""
    return sorted(child for child in child_names(spark, f"{root}/journal") if child.startswith("run="))


def _stored(spark: SparkSession, root: str, schema: StructType | str) -> DataFrame:
    """Columns of the stored results of all closed runs."""
    nothing = empty(spark, schema)
    if not path_exists(spark, f"{root}/results"):
        return nothing
    fields = [field for field in nothing.schema.fields if field.name != "run"]
    stored = spark.read.schema(StructType([*fields, StructField("run", StringType())])).parquet(f"{root}/results")
    unfinished = [name.removeprefix("run=") for name in open_runs(spark, root)]
    return stored.filter(~F.col("run").isin(unfinished)).select(*nothing.columns)


def results(spark: SparkSession, root: str) -> DataFrame:
    """All results of earlier runs."""
    return _stored(spark, root, RESULT_SCHEMA)


def bucketed(rows: DataFrame, kind: str) -> DataFrame:
    """Rows with the bucket that holds what is known of them."""
    columns = {"handled": [F.col("path")], "registry": [F.col("md5")]}
    key = columns.get(kind) or [name_family(F.col("destination"), F.col("file_name"))]
    return rows.withColumn("bucket", bucket(*key))


def known(rows: DataFrame, root: str, kind: str) -> DataFrame:
    """What earlier runs know of the given files, contents or names, and of others in their buckets."""
    return read_state(rows.sparkSession, f"{root}/state/{kind}", STATE[kind][2], bucketed(rows, kind))


def _add_state(spark: SparkSession, root: str, run: str, done: DataFrame) -> None:
    """Add what follows from results to the state, under the name of a run."""
    rows = {
        "handled": done.select("path", "modificationTime", "length"),
        "registry": done.filter("registered").select("md5"),
        "names": name_state(done).withColumn("last", F.col("last").cast("long")),
    }
    for kind, (key, value, _) in STATE.items():
        put_state(bucketed(rows[kind], kind), f"{root}/state/{kind}", run, key, value)


def _results_with_times() -> StructType:
    return StructType([*RESULT_SCHEMA.fields, StructField("modificationTime", TimestampType())])


def _make_state(spark: SparkSession, root: str) -> None:
    """Make the state of a root whose runs did not keep any."""
    if closed_runs(spark, root) and not all(has_state(spark, f"{root}/state/{kind}") for kind in STATE):
        _add_state(spark, root, "run=0", _stored(spark, root, _results_with_times()))


def run_folder(
    spark: SparkSession,
    folder: str,
    root: str,
    settings: Settings,
    listing: DataFrame | None = None,
) -> DataFrame:
    """Triage a folder, copy its files to their places, verify; returns the new results.

    The sources stay where they are: removing them is left to the owner of the folder, after the
    results show what arrived.  A file that an earlier run handled (same path, time and length) is
    left out.  Names that the destinations hold already are not given again, whoever put them
    there; what arrived is looked up at the destinations, by name and length.  A run that died is
    finished first; its results are then results of an earlier run.  Only one run at a time may write
    to a root.
    """
    started = time.time()
    recover(spark, root)
    run = f"run={int(started * 1e6):016d}-{uuid.uuid4().hex}"
    with job_stages(spark):
        listed = list_folder(spark, folder) if listing is None else listing
        listed = listed.select("path", "modificationTime", "length")
        listed = stage(listed, "listed")
        new = stage(listed.join(known(listed, root, "handled"), listed.columns, "left_anti"), "listing")
        if new.isEmpty():
            return empty(spark, RESULT_SCHEMA)

        def registry(facts: DataFrame) -> DataFrame:
            return known(facts.filter("length > 0"), root, "registry")

        def occupied(decided: DataFrame) -> DataFrame:
            names = known(decided.filter("destination IS NOT NULL"), root, "names")
            return names.groupBy("destination", "file_name").agg(F.max("last").alias("last"))

        def taken(named: DataFrame, attempt: int) -> DataFrame:
            if attempt <= LOOK_UPS:
                return held_files(named, root).select("destination", "final_name")
            # Foreign files follow one another: list the folders this run writes to.
            touched = named.filter("destination IS NOT NULL").select("destination").distinct()
            return folder_listing(touched, root).select("destination", "final_name")

        planned = triage_folder(spark, folder, settings, registry, occupied, new, taken=taken)
        times = new.select("path", "modificationTime")
        plan = planned.join(times, "path")
        plan.write.parquet(f"{root}/journal/{run}/plan")
    finish(spark, root, run, started)
    return spark.read.schema(RESULT_SCHEMA).parquet(f"{root}/results/{run}")


def recover(spark: SparkSession, root: str) -> list[str]:
    """Finish or drop every run that was begun and not closed; returns those that were finished."""
    _make_state(spark, root)
    return [run for run in open_runs(spark, root) if finish(spark, root, run, time.time())]


def finish(spark: SparkSession, root: str, run: str, started: float) -> bool:
    """Carry out the plan of a run and close it; every step may be repeated.

    Without a whole plan the run is dropped: nothing was copied for it."""
    journal, stored = f"{root}/journal/{run}", f"{root}/results/{run}"
    planned = path_exists(spark, f"{journal}/plan/_SUCCESS")
    if planned and not path_exists(spark, f"{stored}/_SUCCESS"):
        with job_stages(spark):
            plan = spark.read.parquet(f"{journal}/plan")
            copied = stage(copy_files(plan, root, f"{journal}/parts"), "manifest").filter("copied")
            whole = plan.join(copied.select("path"), "path", "left_semi")
            arrived = whole.join(held_files(whole, root), ["destination", "final_name", "length"])
            done = verified(plan, stage(arrived.select("destination", "final_name"), "arrived"))
            rows = done.select(
                *RESULT_SCHEMA.names,
                "modificationTime",
                F.lit(round(time.time() - started, 2)).alias("time_taken"),
                F.current_timestamp().alias("reported_at"),
            )
            rows.write.mode("overwrite").parquet(stored)
    if planned and not path_exists(spark, f"{root}/totals/{run}/_SUCCESS"):
        done = spark.read.schema(RESULT_SCHEMA).parquet(stored)
        both = metrics.totals(done)
        both.write.mode("overwrite").parquet(f"{root}/totals/{run}")
    if planned:
        _add_state(spark, root, run, spark.read.schema(_results_with_times()).parquet(stored))
    delete_path(spark, journal)
    return planned


def watch(
    spark: SparkSession, folder: str, root: str, settings: Settings, every: str = "5 seconds"
) -> StreamingQuery:
    """Run the folder job again and again, on the files that have come since.

    The stream only keeps time.  What a run must do follows from the listing and the stored
    results, so empty and hidden files count, and a repeated tick handles no file twice.
    """

    def sort(tick: DataFrame, batch_id: int) -> None:
        run_folder(tick.sparkSession, folder, root, settings)

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    writer = ticks.writeStream.foreachBatch(sort).option("checkpointLocation", f"{root}/checkpoint")
    return writer.trigger(processingTime=every).start()


def closed_runs(spark: SparkSession, root: str) -> list[str]:
    """Names of the closed runs, newest first."""
    unfinished = set(open_runs(spark, root))
    names = child_names(spark, f"{root}/results")
    return sorted((n for n in names if n.startswith("run=") and n not in unfinished), reverse=True)


def recent(spark: SparkSession, root: str, count: int = fixed.RECENT_RESULTS) -> DataFrame:
    """The newest results over all runs, with the clock time of their run.

    Runs are opened from the newest on, twice as many each time, until they hold ``count`` rows."""
    schema = StructType([*RESULT_SCHEMA.fields, StructField("run", StringType())])
    names, opened, stored = closed_runs(spark, root), 0, empty(spark, schema)
    while opened < len(names):
        opened = min(len(names), max(1, 2 * opened))
        reader = spark.read.schema(schema).option("basePath", f"{root}/results")
        stored = reader.parquet(*[f"{root}/results/{name}" for name in names[:opened]])
        if stored.limit(count).count() >= count:
            break
    began = F.timestamp_micros(F.substring("run", 1, 16).cast("long"))
    return recent_results(stored.withColumn("moment", began), ["run", "arrival_seq"], "moment", count).drop("moment")


def summary(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Counters and batch totals over all runs, from the one row that each run stored of them."""
    names = closed_runs(spark, root)
    if not names:
        nothing = results(spark, root)
        return metrics.counters(nothing), metrics.batch_summary(nothing)
    stored = spark.read.parquet(*[f"{root}/totals/{name}" for name in names])
    sums = lambda part: [F.sum(F.col(f"{part}.{c}")).alias(c) for c in stored.schema[part].dataType.names]
    return stored.agg(*sums("counters")), stored.agg(*sums("batch"))


def log(spark: SparkSession, root: str) -> DataFrame:
    """The reports of all runs, in order of the runs and of the arrivals in each."""
    schema = StructType(
        [*RESULT_SCHEMA.fields, StructField("time_taken", DoubleType()), StructField("reported_at", TimestampType())]
    )
    report = report_rows(_stored(spark, root, schema), F.col("time_taken"), F.col("reported_at"))
    lines = log_lines(report, "reported_at").orderBy("reported_at", "seq").select("seq", "entry")
    return log_or_notice(lines)
