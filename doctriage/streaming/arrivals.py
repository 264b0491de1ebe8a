"""Triage of files as they arrive, in micro-batches.

Results are written per batch to ``batch_id=<n>`` with overwrite, so a replayed batch replaces
its own rows.  What a batch must know of the past (registered contents, given names) is read from
the batches before it, never from its own folder: from the last snapshot of both tables and the
few batches since.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from doctriage.operators.metrics import counter_bucket
from doctriage.operators.naming import name_state
from doctriage.operators.reports import recent_results
from doctriage.plans.local import RESULT_SCHEMA, Settings, triage
from doctriage.session import job_stages, path_exists
from doctriage.sinks.logs import latest_per_key

SNAPSHOT_EVERY = 20


def stream_folder(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Files as they appear in a folder.  The file source does not report empty files and hidden
    names; ``plans.runs.watch`` sorts a folder with all its files."""
    reader = spark.readStream.format("binaryFile").schema(
        "path string, modificationTime timestamp, length long, content binary"
    )
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """All results so far, with their ``batch_id``; empty before the first batch."""
    schema = StructType([*RESULT_SCHEMA.fields, StructField("batch_id", LongType())])
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def state_before(
    spark: SparkSession, path: str, batch_id: int, every: int = SNAPSHOT_EVERY
) -> tuple[DataFrame, DataFrame]:
    """Registered contents (``md5``) and given names (``name_state``) of all batches before one.

    The first batch of each ``every`` merges the last snapshot with the batches since into a new
    one.  A snapshot depends only on finished batches, so a replay may write it again; where none
    is whole, all earlier results are read.
    """
    cut = batch_id // every * every
    if cut and not _whole(spark, path, cut):
        registry, names = _merged(spark, path, cut - every, cut)
        registry.distinct().write.mode("overwrite").parquet(f"{_snapshot(path, cut)}/registry")
        last = names.groupBy("destination", "file_name").agg(F.max("last").alias("last"))
        last.write.mode("overwrite").parquet(f"{_snapshot(path, cut)}/names")
    return _merged(spark, path, cut, batch_id)


def _snapshot(path: str, cut: int) -> str:
    return f"{path}_state/before={cut}"


def _whole(spark: SparkSession, path: str, cut: int) -> bool:
    """The names are written last."""
    return path_exists(spark, f"{_snapshot(path, cut)}/names/_SUCCESS")


def _merged(spark: SparkSession, path: str, cut: int, end: int) -> tuple[DataFrame, DataFrame]:
    if not (cut and _whole(spark, path, cut)):
        past = read_results(spark, path).filter(F.col("batch_id") < end)
        return past.filter("registered").select("md5"), name_state(past)
    folders = [f"{path}/batch_id={number}" for number in range(cut, end)]
    folders = [folder for folder in folders if path_exists(spark, folder)]
    recent = spark.read.schema(RESULT_SCHEMA).parquet(*folders) if folders else None
    if recent is None:
        recent = spark.createDataFrame([], RESULT_SCHEMA)
    registry = spark.read.parquet(f"{_snapshot(path, cut)}/registry")
    names = spark.read.parquet(f"{_snapshot(path, cut)}/names")
    return registry.unionByName(recent.filter("registered").select("md5")), names.unionByName(name_state(recent))


def start(
    files: DataFrame,
    settings: Settings,
    results_path: str,
    checkpoint: str,
    prepare=lambda batch: batch,
    available_now: bool = True,
    snapshot_every: int = SNAPSHOT_EVERY,
) -> StreamingQuery:
    """Start the stream.  ``prepare`` turns a micro-batch into the input of ``triage``."""

    def process(batch: DataFrame, batch_id: int) -> None:
        registry, names = state_before(batch.sparkSession, results_path, batch_id, snapshot_every)
        with job_stages(batch.sparkSession):
            results = triage(prepare(batch), settings, registry, names)
            results.write.mode("overwrite").parquet(f"{results_path}/batch_id={batch_id}")

    writer = files.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def counter_stream(results: DataFrame) -> DataFrame:
    """Running counters over a stream of results; the state is one row per counter."""
    bucket = counter_bucket(F.col("document_type"), F.col("status"))
    return results.groupBy(bucket.alias("counter")).agg(F.count("*").alias("n"))


def latest_stream(items: DataFrame, key: str, order: str) -> DataFrame:
    """Running latest item per key; the state holds one row per key."""
    rest = [name for name in items.columns if name != key]
    newest = F.max_by(F.struct(*rest), F.col(order)).alias("item")
    return items.groupBy(key).agg(newest).select(key, "item.*")


def keep_updates(
    updates: DataFrame, path: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Write what changed per micro-batch, so that neither driver nor task holds the whole state."""

    def process(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = updates.writeStream.outputMode("update").foreachBatch(process)
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_updates(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The current state: the last update of each key."""
    return latest_per_key(spark.read.parquet(path), key, "batch_id").drop("batch_id")


def stream_results(spark: SparkSession, path: str) -> DataFrame:
    """The written results as a stream of their own."""
    return spark.readStream.schema(RESULT_SCHEMA).parquet(f"{path}/batch_id=*")


def latest_results(spark: SparkSession, path: str, moment: Column) -> DataFrame:
    """The newest results over all batches with the clock time of ``moment``."""
    results = read_results(spark, path).withColumn("moment", moment)
    return recent_results(results, ["batch_id", "arrival_seq"], "moment").drop("moment")
