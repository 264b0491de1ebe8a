"""The event-driven variant: no validation, no duplicates, no threshold, names overwrite."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doctriage import fixed
from doctriage.functions.text import is_readable
from doctriage.operators.extraction import cloud_text
from doctriage.operators.model import TextModel, reported_confidence
from doctriage.operators.reports import cloud_log_rows
from doctriage.operators.routing import destination_key
from doctriage.operators.skew import join_facts
from doctriage.session import child_names, delete_path, job_stages, path_exists, stage
from doctriage.sinks.files import copy_objects, remove_objects
from doctriage.sinks.logs import has_run, latest_per_key, put_items
from doctriage.sources.files import fetch, with_names


def object_facts(objects: DataFrame, model: TextModel | None) -> DataFrame:
    """Status, type and confidence of stored objects (``bucket, key, file_ext, content, blocks``).

    Depends on the object alone, so it runs once per object however many events name it.  Any
    failure to read is unsupported.  Without a model everything readable is Unknown at 0.
    """
    text = cloud_text(F.col("file_ext"), F.col("content"), F.col("blocks"))
    read = objects.withColumn("_text", text).withColumn("_readable", is_readable(F.col("_text")))
    if model is not None:
        read = model.score(read.withColumn("_scored", F.when(F.col("_readable"), F.col("_text"))), "_scored")
        label, confidence = F.col("ml_label"), F.col("ml_confidence")
    else:
        label, confidence = F.lit(fixed.UNKNOWN), F.lit(0.0)
    return read.select(
        "bucket",
        "key",
        F.when(F.col("_readable"), "success").otherwise("unsupported").alias("status"),
        F.when(F.col("_readable"), label).alias("document_type"),
        F.when(F.col("_readable"), confidence).otherwise(0.0).alias("confidence"),
    )


def handle_events(events: DataFrame, facts: DataFrame, order: str = "seq") -> DataFrame:
    """One result per event record: ``events`` (``bucket, key, filename, seq``) against facts.

    A record whose object is missing is unsupported and not moved.  The destination of an
    unsupported object is the default prefix, whatever its log row says.
    """
    lookup = facts.withColumn("_object", F.concat_ws("/", "bucket", "key")).drop("bucket", "key")
    keyed = events.withColumn("_object", F.concat_ws("/", "bucket", "key"))
    sizes = keyed.groupBy("_object").agg(F.count("*").alias("_events"))
    joined = join_facts(keyed, lookup.join(sizes, "_object"), "_object", "_events").drop("_object")
    present = F.col("status").isNotNull()
    return (
        joined.withColumn("_present", present)
        .withColumn("status", F.coalesce("status", F.lit("unsupported")))
        .withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
        .withColumn(
            "dest_key",
            F.when(
                F.col("_present"),
                destination_key(F.coalesce("document_type", F.lit("unsupported")), F.col("key")),
            ),
        )
        .drop("_present")
    )


def response_body(results: DataFrame) -> DataFrame:
    """JSON body returned per success; unsupported files return a plain sentence."""
    body = F.to_json(
        F.struct(
            "filename",
            "document_type",
            reported_confidence(F.col("confidence")).alias("confidence"),
            F.col("dest_key").alias("destination"),
            "status",
        )
    )
    plain = F.lit("file moved to unsupported folder")
    return results.withColumn("body", F.when(F.col("status") == "success", body).otherwise(plain))


EVENT_KEY = ("bucket", "key", "version")


def open_runs(spark: SparkSession, root: str) -> list[str]:
    """Names of the runs that were begun and not closed."""
    return sorted(child for child in child_names(spark, f"{root}/outbox") if child.startswith("run="))


def answered(spark: SparkSession, root: str) -> DataFrame | None:
    """The results of all closed runs with their ``run``; None before the first."""
    if not path_exists(spark, f"{root}/results"):
        return None
    unfinished = [name.removeprefix("run=") for name in open_runs(spark, root)]
    runs = spark.read.parquet(f"{root}/results")
    return runs.withColumn("run", F.col("run").cast("string")).filter(~F.col("run").isin(unfinished))


def run_events(
    spark: SparkSession,
    events: DataFrame,
    store: str,
    root: str,
    model: TextModel | None = None,
    blocks: DataFrame | None = None,
) -> DataFrame:
    """Handle object events (``seq, bucket, key, filename``) with the objects they name.

    Objects are read on the executors from ``store/<bucket>/<key>``; ``blocks`` (``bucket, key,
    blocks``) holds OCR responses for images.  They are moved to ``root/organised/<dest_key>`` and
    logged in ``root/log``.  The results, kept in ``root/results``, gain ``moved`` and ``body``.
    An object that could not be moved stays where it is and has no ``dest_key``; it is logged as a
    success at ``unknown`` all the same.

    An event is known by bucket, key and ``version`` (its own column, else ``seq``).  One that was
    answered before is not handled again: its result is returned as it was, and nothing is logged or
    moved for it.  One that comes twice in ``events`` is handled once, as its first by ``seq``.

    The work to do is written to ``root/outbox/run=<id>`` before anything is moved.  Objects are
    copied, results and log rows are written, and only then the sources are removed; a run that was
    stopped is finished by the next one, from its outbox.
    """
    started = time.time()
    recover(spark, root)
    run = f"run={int(started * 1e6):016d}-{uuid.uuid4().hex}"
    if "version" not in events.columns:
        events = events.withColumn("version", F.col("seq").cast("string"))
    base = store.rstrip("/")
    with job_stages(spark):
        source = F.concat_ws("/", F.lit(base), "bucket", "key")
        once = latest_per_key(events.withColumn("path", source), list(EVENT_KEY), -F.col("seq"))
        arrived = stage(once, "events")
        past = answered(spark, root)
        fresh, repeated = arrived, None
        if past is not None:
            known = past.join(arrived.select(*EVENT_KEY), list(EVENT_KEY), "left_semi")
            repeated = stage(known.select(*EVENT_KEY), "answered")
            fresh = arrived.join(repeated, list(EVENT_KEY), "left_anti")
        plan_events(spark, fresh, base, model, blocks).write.parquet(f"{root}/outbox/{run}/plan")
        again = repeated is not None and not repeated.isEmpty()
    finish(spark, root, run, started)
    done = spark.read.parquet(f"{root}/results/{run}")
    if not again:
        return done
    earlier = answered(spark, root).filter(F.col("run") != run.removeprefix("run=")).drop("run")
    return done.unionByName(earlier.join(events.select(*EVENT_KEY).distinct(), list(EVENT_KEY), "left_semi"), True)


def plan_events(
    spark: SparkSession, events: DataFrame, store: str, model: TextModel | None, blocks: DataFrame | None
) -> DataFrame:
    """What each event's object is and where it goes; ``events`` have the ``path`` of their object."""
    named = events.select("path", "bucket", "key", F.lit(None).cast("timestamp").alias("modificationTime")).distinct()
    read = fetch(named).filter(F.col("length").isNotNull()).select("path", "content")
    objects = with_names(read).withColumn("_inner", F.substr("path", F.lit(len(store) + 2)))
    objects = objects.select(
        F.substring_index("_inner", "/", 1).alias("bucket"),
        F.regexp_replace("_inner", "^[^/]*/", "").alias("key"),
        "file_ext",
        "content",
    )
    if blocks is None:
        nothing = F.lit(None).cast("array<struct<BlockType:string,Text:string>>")
        objects = objects.withColumn("blocks", nothing)
    else:
        objects = objects.join(blocks, ["bucket", "key"], "left")
    return handle_events(events, stage(object_facts(objects, model), "object-facts"))


def recover(spark: SparkSession, root: str) -> list[str]:
    """Finish or drop every run that was begun and not closed; returns those that were finished."""
    return [run for run in open_runs(spark, root) if finish(spark, root, run, time.time())]


def finish(spark: SparkSession, root: str, run: str, started: float) -> bool:
    """Carry out the outbox of a run; every step may be repeated, and sources go last.

    Without a whole plan the run is dropped: nothing was moved for it.  If a source cannot be removed,
    the outbox stays open and the next run tries again."""
    outbox, stored = f"{root}/outbox/{run}", f"{root}/results/{run}"
    if not path_exists(spark, f"{outbox}/plan/_SUCCESS"):
        delete_path(spark, outbox)
        return False
    with job_stages(spark):
        plan = spark.read.parquet(f"{outbox}/plan")
        if not path_exists(spark, f"{stored}/_SUCCESS"):
            copied = copy_objects(plan.filter(F.col("dest_key").isNotNull()), f"{root}/organised", f"{outbox}/parts")
            results = plan.join(copied, "seq", "left").withColumn("moved", F.coalesce("copied", F.lit(False)))
            results = results.withColumn("dest_key", F.when(F.col("moved"), F.col("dest_key"))).drop("copied", "path")
            response_body(results).write.mode("overwrite").parquet(stored)
        done = spark.read.parquet(stored)
        if not has_run(spark, f"{root}/log", run):
            seconds = F.lit(round(time.time() - started, 2))
            put_items(cloud_log_rows(done, seconds, F.current_timestamp()), f"{root}/log", run)
        moved = plan.join(done.filter("moved").select("seq"), "seq", "left_semi")
        left = stage(remove_objects(moved), "removed").filter("NOT removed")
        closed = left.isEmpty()
    if closed:
        delete_path(spark, outbox)
    return True
