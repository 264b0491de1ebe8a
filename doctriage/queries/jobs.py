"""Whole jobs on the given tables: triage, verification, the cloud variant, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doctriage import fixed
from doctriage.functions.paths import base_name
from doctriage.operators import metrics, reports, routing
from doctriage.plans import cloud, local
from doctriage.queries.learning import CLASSIFIED_SQL, ROUTE_SQL, SCORES_SQL, digest_model, responder_by_length
from doctriage.queries.registry import FILES_SQL, SUPPORTED, files_with_text, query, sql_ext, sql_strip, table
from doctriage.queries.texts import OBJECTS_SQL, stored_objects
from doctriage.session import shared_folder, stage
from doctriage.sinks import logs
from doctriage.sources.files import fetch, list_folder, with_names
from doctriage.sources.store import open_store
from doctriage.streaming import arrivals


def triage_sql(has_model: bool) -> str:
    """CTEs ending in ``results``: the outcome of every file of ``files_v``."""
    classified = "'classified'" if has_model else "'error'"
    registers = "length > 0 AND readable"
    if not has_model:
        registers += " AND file_ext IN ('.pptx', '.xlsx')"
    typed = (
        "CASE outcome WHEN 'non-document' THEN 'Unknown' WHEN 'classified' THEN c.document_type END"
        if has_model
        else "CASE outcome WHEN 'non-document' THEN 'Unknown' END"
    )
    confidence = (
        "CASE outcome WHEN 'non-document' THEN 0.0::DOUBLE WHEN 'classified' THEN c.confidence END"
        if has_model
        else "CASE outcome WHEN 'non-document' THEN 0.0::DOUBLE END"
    )
    method = (
        "CASE outcome WHEN 'non-document' THEN 'file type check' WHEN 'classified' THEN c.method END"
        if has_model
        else "CASE outcome WHEN 'non-document' THEN 'file type check' END"
    )
    join = "LEFT JOIN classified c USING (doc_id)" if has_model else ""
    return f"""
{FILES_SQL}, registered_first AS (
    SELECT md5, min(arrival_seq) FILTER (WHERE {registers}) AS first_registered FROM facts GROUP BY md5
), outcomes AS (
    SELECT f.*, {registers} AND NOT coalesce(arrival_seq > first_registered, FALSE) AS registered,
           CASE WHEN length = 0 THEN 'rejected'
                WHEN coalesce(arrival_seq > first_registered, FALSE) THEN 'duplicate'
                WHEN NOT readable AND file_ext IN ({SUPPORTED}) THEN 'unreadable'
                WHEN NOT readable THEN 'unsupported'
                WHEN file_ext IN ('.pptx', '.xlsx') THEN 'non-document'
                ELSE {classified} END AS outcome
    FROM facts f JOIN registered_first USING (md5)
), typed AS (
    SELECT o.*, {typed} AS document_type, {confidence} AS confidence, {method} AS method
    FROM outcomes o {join}
), placed AS (
    SELECT *, CASE outcome WHEN 'classified' THEN {ROUTE_SQL}
                   WHEN 'rejected' THEN 'documents/miscellaneous/unreadable' WHEN 'duplicate' THEN 'documents/duplicates'
                   WHEN 'unreadable' THEN 'documents/miscellaneous/unreadable'
                   WHEN 'unsupported' THEN 'documents/miscellaneous/unsupported'
                   WHEN 'non-document' THEN 'documents/unknown' END AS destination,
           CASE WHEN outcome IN ('non-document', 'classified') THEN 'success' ELSE outcome END AS status
    FROM typed
), numbered AS (
    SELECT *, row_number() OVER (PARTITION BY destination, file_name ORDER BY arrival_seq) - 1 AS n FROM placed
), results AS (
    SELECT *, CASE WHEN destination IS NULL THEN NULL WHEN n = 0 THEN file_name
                   ELSE left(file_name, length(file_name) - length({sql_ext('file_name')})) || '_' || n || {sql_ext('file_name')}
              END AS final_name,
           CASE outcome WHEN 'rejected' THEN 'Rejected' WHEN 'duplicate' THEN 'Duplicate' WHEN 'unreadable' THEN 'Unreadable'
                WHEN 'unsupported' THEN 'Unsupported' WHEN 'error' THEN NULL ELSE document_type END AS report_type,
           CASE outcome WHEN 'error' THEN NULL WHEN 'duplicate' THEN 'Yes' ELSE 'No' END AS report_duplicate,
           CASE WHEN outcome = 'error' THEN NULL WHEN outcome IN ('non-document', 'classified') THEN 'Yes' ELSE 'No' END AS report_readable,
           CASE outcome WHEN 'rejected' THEN 'miscellaneous/unreadable' ELSE destination END AS report_destination,
           CASE outcome WHEN 'non-document' THEN 'non-document file type' WHEN 'error' THEN NULL ELSE status END AS report_status
    FROM numbered
)"""


SHOWN = (
    "arrival_seq", "file_name", "outcome", "status", "document_type", "confidence", "method", "destination",
    "final_name", "registered", "report_type", "report_duplicate", "report_readable",
    "report_destination", "report_status",
)
OUTCOME_SQL = triage_sql(False)
RESULTS_SQL = f"{CLASSIFIED_SQL}, {triage_sql(True).strip()}"


def triaged(spark, folder) -> DataFrame:
    settings = local.Settings(model=digest_model(spark, folder), responder=responder_by_length())
    return local.triage(files_with_text(spark, folder), settings)


@query(f"WITH {OUTCOME_SQL} SELECT {', '.join(SHOWN)} FROM results")
def outcome_matrix(spark, folder) -> DataFrame:
    """Triage without a model: what would be classified ends as an error and stays in place."""
    return local.triage(files_with_text(spark, folder), local.Settings()).select(*SHOWN)


@query(f"WITH {RESULTS_SQL} SELECT {', '.join(SHOWN)} FROM results")
def triage_results(spark, folder) -> DataFrame:
    """The full job with model and second opinion."""
    return triaged(spark, folder).select(*SHOWN)


@query(
    f"""
WITH {OUTCOME_SQL}
SELECT coalesce(destination, '(not moved)') AS destination, outcome, count(*) AS files,
       CAST(sum(length) AS BIGINT) AS bytes, count(*) FILTER (WHERE registered) AS registered
FROM results GROUP BY 1, 2
"""
)
def files_per_destination(spark, folder) -> DataFrame:
    results = local.triage(files_with_text(spark, folder), local.Settings())
    place = F.coalesce("destination", F.lit("(not moved)")).alias("destination")
    return results.groupBy(place, "outcome").agg(
        F.count("*").alias("files"),
        F.sum("length").alias("bytes"),
        F.count_if("registered").alias("registered"),
    )


@query(
    f"""
WITH {RESULTS_SQL}
SELECT arrival_seq, status,
       CASE WHEN outcome IN ('classified', 'non-document') THEN file_name END AS file_name,
       CASE WHEN outcome IN ('classified', 'non-document') THEN document_type END AS document_type,
       CASE WHEN outcome IN ('classified', 'non-document') THEN confidence END AS confidence,
       CASE WHEN outcome <> 'rejected' THEN destination || '/' || final_name END AS destination,
       CASE WHEN outcome IN ('classified', 'non-document') THEN method END AS method
FROM results
"""
)
def result_records(spark, folder) -> DataFrame:
    return reports.result_records(triaged(spark, folder))


@query(
    f"""
WITH {RESULTS_SQL}
SELECT count(*) AS total,
       count(*) FILTER (WHERE lower(document_type) = 'resume') AS resumes,
       count(*) FILTER (WHERE lower(document_type) = 'invoice') AS invoices,
       count(*) FILTER (WHERE lower(document_type) = 'paystub') AS paystubs,
       count(*) FILTER (WHERE lower(document_type) = 'contract') AS contracts,
       count(*) FILTER (WHERE status = 'duplicate') AS duplicates,
       count(*) FILTER (WHERE coalesce(document_type, 'Unknown') = 'Unknown' AND status <> 'duplicate') AS failed
FROM results
"""
)
def triage_counters(spark, folder) -> DataFrame:
    return metrics.counters(triaged(spark, folder))


ARRIVED = "CAST('0x' || substr(md5(destination || '/' || final_name), 1, 2) AS BIGINT) < 240"
VERIFIED_SQL = f"""
{RESULTS_SQL}, listing AS (
    SELECT destination, final_name FROM results WHERE destination IS NOT NULL AND {ARRIVED}
), verified AS (
    SELECT r.* REPLACE (
               CASE WHEN outcome = 'classified' AND l.final_name IS NULL THEN 'failed' ELSE status END AS status,
               CASE WHEN outcome = 'classified' AND l.final_name IS NULL THEN 'failed' ELSE report_status END AS report_status),
           l.final_name IS NOT NULL AS arrived
    FROM results r LEFT JOIN listing l USING (destination, final_name)
)"""


def with_listing(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Results, and the listing of a sink that lost the files whose path digest is high."""
    results = triaged(spark, folder)
    digest = F.md5(F.concat_ws("/", "destination", "final_name"))
    arrived = F.conv(F.substring(digest, 1, 2), 16, 10).cast("int") < 240
    return results, results.filter(F.col("destination").isNotNull() & arrived).select("destination", "final_name")


@query(f"WITH {VERIFIED_SQL} SELECT arrival_seq, destination, final_name, status, report_status, arrived FROM verified")
def verified_results(spark, folder) -> DataFrame:
    return local.verified(*with_listing(spark, folder)).select(
        "arrival_seq", "destination", "final_name", "status", "report_status", "arrived"
    )


@query(f"WITH {VERIFIED_SQL} SELECT arrival_seq, destination, final_name FROM verified WHERE NOT arrived AND destination IS NOT NULL")
def missing_arrivals(spark, folder) -> DataFrame:
    results, listing = with_listing(spark, folder)
    planned = results.filter(F.col("destination").isNotNull())
    return routing.not_arrived(planned, listing).select("arrival_seq", "destination", "final_name")


# ---- cloud variant ----------------------------------------------------------------------

def cloud_events(spark, folder) -> DataFrame:
    """One event per turn for the object of its conversation."""
    objects = stored_objects(spark, folder).select("conv_id", "bucket", "key")
    turns = table(spark, folder, "conversations").select("conv_id", "turn")
    events = turns.join(objects, "conv_id").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("seq"), "bucket", "key"
    )
    return with_names(events.withColumn("path", F.col("key"))).select(
        "seq", "bucket", "key", F.col("file_name").alias("filename")
    )


CLOUD_SQL = f"""
{OBJECTS_SQL}, object_facts AS (
    SELECT conv_id, key, coalesce(length({sql_strip('text')}) >= 10, FALSE) AS readable FROM object_texts
), handled AS (
    SELECT t.conv_id * 100 + t.turn AS seq, 'intake' AS bucket, key, regexp_extract(key, '[^/]*$') AS filename,
           CASE WHEN readable THEN 'success' ELSE 'unsupported' END AS status,
           CASE WHEN readable THEN 'Unknown' END AS document_type, 0.0::DOUBLE AS confidence,
           'unknown/' || regexp_extract(key, '[^/]*$') AS dest_key
    FROM conversations t JOIN object_facts USING (conv_id)
)"""


def handled(spark, folder) -> DataFrame:
    facts = cloud.object_facts(stored_objects(spark, folder), None)
    return cloud.handle_events(cloud_events(spark, folder), stage(facts, "object-facts"))


@query(f"WITH {CLOUD_SQL} SELECT * FROM handled")
def cloud_results_without_model(spark, folder) -> DataFrame:
    return handled(spark, folder)


@query(
    f"""
WITH {CLOUD_SQL}, logged AS (
    SELECT filename, CASE status WHEN 'unsupported' THEN 'Unsupported' ELSE document_type END AS document_type,
           CASE status WHEN 'unsupported' THEN '0' ELSE '0.0' END AS confidence,
           CASE status WHEN 'unsupported' THEN 'unsupported/' ELSE dest_key END AS destination,
           CASE status WHEN 'unsupported' THEN '0' ELSE '1.5' END AS time_taken,
           '2024-01-01 00:00:00' AS timestamp, status, seq
    FROM handled
)
SELECT * FROM logged QUALIFY row_number() OVER (PARTITION BY filename ORDER BY seq DESC) = 1
"""
)
def cloud_log(spark, folder) -> DataFrame:
    """Log items of the cloud flow, last write per file name."""
    moment = F.lit("2024-01-01 00:00:00").cast("timestamp")
    items = reports.cloud_log_rows(handled(spark, folder), F.lit(1.5), moment)
    return logs.latest_per_key(items, "filename", "seq")


@query(
    f"""
WITH {CLOUD_SQL}
SELECT seq, CASE status WHEN 'unsupported' THEN 'file moved to unsupported folder'
       ELSE '{{"filename":"' || filename || '","document_type":"Unknown","confidence":0.0,"destination":"' || dest_key
            || '","status":"success"}}' END AS body
FROM handled
"""
)
def cloud_responses(spark, folder) -> DataFrame:
    return cloud.response_body(handled(spark, folder)).select("seq", "body")


# ---- cloud variant with a model: documents as stored objects ---------------------------

CLOUD_MODEL_SQL = f"""
{SCORES_SQL}, stored AS (
    SELECT doc_id, 'in/f' || (doc_id % 37) || CASE WHEN lang = 'es' THEN '.docx' ELSE '.txt' END AS key,
           lang <> 'es' AND length({sql_strip('text')}) >= 10 AS readable
    FROM documents
), moved AS (
    SELECT doc_id AS seq, 'intake' || doc_id AS bucket, key, regexp_extract(key, '[^/]*$') AS filename,
           CASE WHEN readable THEN 'success' ELSE 'unsupported' END AS status,
           CASE WHEN readable THEN ml_label END AS document_type,
           CASE WHEN readable THEN ml_confidence ELSE 0 END AS confidence
    FROM stored JOIN scores USING (doc_id)
)"""


@query(
    f"""
WITH {CLOUD_MODEL_SQL}
SELECT seq, bucket, key, filename, status, document_type, round(confidence, 6) AS confidence,
       CASE document_type WHEN 'Resume' THEN 'hr/resumes/' WHEN 'Invoice' THEN 'finance/invoices/'
            WHEN 'Paystub' THEN 'finance/paystubs/' WHEN 'Contract' THEN 'legal/contracts/' ELSE 'unknown/' END || filename AS dest_key
FROM moved
"""
)
def cloud_results(spark, folder) -> DataFrame:
    documents = table(spark, folder, "documents")
    ext = F.when(F.col("lang") == "es", ".docx").otherwise(".txt")
    objects = documents.select(
        F.concat(F.lit("intake"), F.col("doc_id").cast("string")).alias("bucket"),
        F.concat(F.lit("in/f"), (F.col("doc_id") % 37).cast("string"), ext).alias("key"),
        ext.alias("file_ext"),
        F.encode("text", "UTF-8").alias("content"),
        F.lit(None).cast("array<struct<BlockType:string,Text:string>>").alias("blocks"),
        "doc_id",
    )
    facts = stage(cloud.object_facts(objects, digest_model(spark, folder)), "object-facts")
    events = with_names(
        objects.select(F.col("doc_id").alias("seq"), "bucket", "key", F.col("key").alias("path"))
    ).select("seq", "bucket", "key", F.col("file_name").alias("filename"))
    return cloud.handle_events(events, facts).withColumn("confidence", F.round("confidence", 6))


# ---- cloud job: real objects, some of which cannot be moved -----------------------------

OBJECT_NAMES = 211

CLOUD_JOB_SQL = f"""
objects AS (
    SELECT doc_id, 'f' || doc_id % {OBJECT_NAMES} || CASE WHEN lang = 'es' THEN '.docx' ELSE '.txt' END AS filename,
           lang <> 'es' AND length({sql_strip('text')}) >= 10 AS readable, doc_id % {OBJECT_NAMES} % 7 > 0 AS moved
    FROM documents
), handled AS (
    SELECT doc_id AS seq, filename, CASE WHEN readable THEN 'success' ELSE 'unsupported' END AS status, moved,
           CASE WHEN moved THEN 'unknown/' || filename END AS dest_key,
           CASE WHEN NOT readable THEN 'unsupported/' WHEN moved THEN 'unknown/' || filename ELSE 'unknown' END AS logged
    FROM objects
)"""


@query(
    f"""
WITH {CLOUD_JOB_SQL}
SELECT seq, filename, status, moved, dest_key, NOT moved AS stayed,
       last(logged) OVER (PARTITION BY filename ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS logged,
       CASE WHEN moved THEN last(md5(text)) OVER (PARTITION BY filename ORDER BY seq
            ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) END AS sink_md5
FROM handled JOIN documents ON doc_id = seq
"""
)
def cloud_job(spark, folder) -> DataFrame:
    """Documents stored as objects, read, moved and logged as their events say.

    Every seventh name is taken by a folder at the destination, so its objects cannot be moved.
    """
    base = f"{shared_folder(spark)}/buckets/{uuid.uuid4().hex}"
    number = F.col("doc_id") % OBJECT_NAMES
    ext = F.when(F.col("lang") == "es", ".docx").otherwise(".txt")
    objects = table(spark, folder, "documents").select(
        F.col("doc_id").alias("seq"),
        F.lit("intake").alias("bucket"),
        F.concat(F.lit("in/"), F.col("doc_id").cast("string"), F.lit("/f"), number.cast("string"), ext).alias("key"),
        F.concat(F.lit("f"), number.cast("string"), ext).alias("filename"),
        (number % 7 == 0).alias("blocked"),
        "text",
    )

    def write(batches):
        store, place = open_store(base)
        for batch in batches:
            # Row by row out of the Arrow batch: the texts of a batch are there once.
            for bucket, key, name, blocked, text in zip(*(batch[column] for column in shown)):
                target = f"{place}/store/{bucket}/{key}"
                store.create_dir(target.rpartition("/")[0], recursive=True)
                with store.open_output_stream(target) as stream:
                    stream.write((text.as_py() or "").encode("utf-8"))
                if blocked.as_py():
                    store.create_dir(f"{place}/organised/unknown/{name}", recursive=True)
            yield batch.select(["seq"])

    shown = ("bucket", "key", "filename", "blocked", "text")
    objects.mapInArrow(write, "seq long").write.format("noop").mode("overwrite").save()
    events = objects.select("seq", "bucket", "key", "filename")
    done = cloud.run_events(spark, events, f"{base}/store", base)
    left = list_folder(spark, f"{base}/store", below=True).select(
        F.regexp_extract("path", "/in/([0-9]+)/", 1).cast("long").alias("seq"), F.lit(True).alias("_stayed")
    )
    sunk = fetch(list_folder(spark, f"{base}/organised", below=True)).select(
        F.concat(F.lit("unknown/"), base_name(F.col("path"))).alias("dest_key"), F.col("md5").alias("sink_md5")
    )
    logged = logs.read_items(spark, f"{base}/log").select("filename", F.col("destination").alias("logged"))
    joined = done.join(left, "seq", "left").join(sunk, "dest_key", "left").join(logged, "filename")
    return joined.select(
        "seq", "filename", "status", "moved", "dest_key", F.coalesce("_stayed", F.lit(False)).alias("stayed"),
        "logged", "sink_md5",
    )


# ---- streams ----------------------------------------------------------------------------

BATCHES = 4


def streamed(spark, folder, settings: local.Settings) -> str:
    """Let the files arrive in consecutive batches, each handled by a restarted stream.

    Returns the folder of the results.
    """
    files = files_with_text(spark, folder)
    root = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    shares = [i / BATCHES for i in range(1, BATCHES)]
    bounds = files.agg(F.percentile_approx("arrival_seq", shares)).first()[0]
    limits = [None, *bounds, None]
    for low, high in zip(limits, limits[1:]):
        arrived = files
        if low is not None:
            arrived = arrived.filter(F.col("arrival_seq") > low)
        if high is not None:
            arrived = arrived.filter(F.col("arrival_seq") <= high)
        arrived.write.mode("append").parquet(f"{root}/uploads")
        source = spark.readStream.schema(files.schema).parquet(f"{root}/uploads")
        arrivals.start(source, settings, f"{root}/results", f"{root}/checkpoint").awaitTermination()
    return f"{root}/results"


@query(f"WITH {OUTCOME_SQL} SELECT {', '.join(SHOWN)} FROM results")
def stream_triage(spark, folder) -> DataFrame:
    """The same files in consecutive micro-batches give the results of one batch."""
    return arrivals.read_results(spark, streamed(spark, folder, local.Settings())).select(*SHOWN)


@query(
    f"""
WITH {OUTCOME_SQL}
SELECT CASE WHEN status = 'duplicate' THEN 'duplicates' ELSE 'failed' END AS counter, count(*) AS n
FROM results GROUP BY 1
"""
)
def stream_counters(spark, folder) -> DataFrame:
    """Counters kept by a second stream over the results of the first."""
    results = arrivals.stream_results(spark, streamed(spark, folder, local.Settings()))
    root = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    counted = arrivals.counter_stream(results)
    arrivals.keep_updates(counted, f"{root}/counters", f"{root}/checkpoint").awaitTermination()
    return arrivals.read_updates(spark, f"{root}/counters", "counter")


@query(
    f"""
WITH {OUTCOME_SQL}
SELECT arrival_seq, file_name, status FROM results ORDER BY arrival_seq DESC LIMIT {fixed.RECENT_RESULTS}
"""
)
def stream_recent(spark, folder) -> DataFrame:
    path = streamed(spark, folder, local.Settings())
    latest = arrivals.latest_results(spark, path, F.timestamp_seconds("arrival_seq"))
    return latest.select("arrival_seq", "file_name", "status")


@query(
    """
SELECT user_id, event_id, event_type FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events
) WHERE n = 1
"""
)
def stream_latest(spark, folder) -> DataFrame:
    """Latest event per user kept as stream state."""
    schema = table(spark, folder, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    latest = arrivals.latest_stream(source.select("user_id", "event_id", "event_type"), "user_id", "event_id")
    root = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    arrivals.keep_updates(latest, f"{root}/latest", f"{root}/checkpoint").awaitTermination()
    return arrivals.read_updates(spark, f"{root}/latest", "user_id")
