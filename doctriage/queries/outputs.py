"""Counters, recent results, reports, logs and keyed items."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doctriage.operators import metrics, reports
from doctriage.queries.registry import FILES_SQL, files_with_text, pick, query, sql_list, sql_round, table
from doctriage.session import shared_folder
from doctriage.sinks import files as file_sink
from doctriage.sinks import logs

# Events as results: the type of the event stands for what became of a file.
KINDS = ("Resume", "invoice", "Paystub", "CONTRACT", "Unknown")
STATES = ("success", "duplicate", "failed")

RECORDS_SQL = f"""
records AS (
    SELECT event_id, ts, event_type, user_id, value,
           CASE event_type WHEN 'view' THEN ([{sql_list(KINDS)}])[user_id % 5 + 1] WHEN 'click' THEN '' END AS document_type,
           ([{sql_list(STATES)}])[event_id % 3 + 1] AS status,
           CASE WHEN event_type = 'view' THEN {sql_round('value', 1)} END AS confidence,
           CASE WHEN event_type = 'view' THEN 'ML Model' END AS method,
           'user' || user_id || '.txt' AS file_name,
           CASE event_type WHEN 'view' THEN {sql_round('value / 7', 2)} WHEN 'click' THEN 0.0::DOUBLE END AS time_taken,
           CASE WHEN event_type <> 'error' THEN 'documents/' || event_type END AS destination
    FROM events
)"""


def records(spark, folder) -> DataFrame:
    seen = F.col("event_type") == "view"
    return table(spark, folder, "events").select(
        "event_id", "ts", "event_type", "user_id", "value",
        F.when(seen, pick(KINDS, F.col("user_id") % 5)).when(F.col("event_type") == "click", "").alias("document_type"),
        pick(STATES, F.col("event_id") % 3).alias("status"),
        F.when(seen, reports.round_half_even(F.col("value"), 1)).alias("confidence"),
        F.when(seen, "ML Model").alias("method"),
        F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit(".txt")).alias("file_name"),
        F.when(seen, reports.round_half_even(F.col("value") / 7, 2)).when(F.col("event_type") == "click", 0.0)
        .alias("time_taken"),
        F.when(F.col("event_type") != "error", F.concat(F.lit("documents/"), "event_type")).alias("destination"),
    )


BUCKET_SQL = """CASE lower(coalesce(document_type, '')) WHEN 'resume' THEN 'resumes' WHEN 'invoice' THEN 'invoices'
    WHEN 'paystub' THEN 'paystubs' WHEN 'contract' THEN 'contracts'
    ELSE CASE WHEN status = 'duplicate' THEN 'duplicates' ELSE 'failed' END END"""
COUNTERS_SQL = f"""
{RECORDS_SQL}, buckets AS (SELECT {BUCKET_SQL} AS bucket FROM records), counters AS (
    SELECT count(*) AS total, count(*) FILTER (WHERE bucket = 'resumes') AS resumes,
           count(*) FILTER (WHERE bucket = 'invoices') AS invoices, count(*) FILTER (WHERE bucket = 'paystubs') AS paystubs,
           count(*) FILTER (WHERE bucket = 'contracts') AS contracts,
           count(*) FILTER (WHERE bucket = 'duplicates') AS duplicates, count(*) FILTER (WHERE bucket = 'failed') AS failed
    FROM buckets
)"""


@query(f"WITH {COUNTERS_SQL} SELECT * FROM counters")
def counters(spark, folder) -> DataFrame:
    return metrics.counters(records(spark, folder))


@query(
    f"""
WITH {COUNTERS_SQL}, cells AS (
    SELECT unnest(['resumes', 'invoices', 'paystubs', 'contracts']) AS name,
           unnest([resumes, invoices, paystubs, contracts]) AS count,
           greatest(resumes, invoices, paystubs, contracts, 1) AS highest FROM counters
)
SELECT name, count, round(count / highest::DOUBLE * 100, 9) AS width FROM cells
"""
)
def counter_bars(spark, folder) -> DataFrame:
    bars = metrics.bars(metrics.counters(records(spark, folder)))
    return bars.select("name", "count", F.round("width", 9).alias("width"))


@query(
    f"""
WITH {RECORDS_SQL}
SELECT count(*) AS total, count(*) FILTER (WHERE status = 'success') AS success,
       count(*) - count(*) FILTER (WHERE status = 'success') AS failed FROM records
"""
)
def batch_summary(spark, folder) -> DataFrame:
    return metrics.batch_summary(records(spark, folder))


RECENT_SQL = f"""
{RECORDS_SQL}, recent AS (
    SELECT *, strftime(ts, '%H:%M:%S') AS clock FROM records ORDER BY event_id DESC LIMIT 20
)"""


@query(f"WITH {RECENT_SQL} SELECT event_id, file_name, document_type, status, confidence, clock AS timestamp FROM recent")
def recent_results(spark, folder) -> DataFrame:
    recent = reports.recent_results(records(spark, folder), "event_id", "ts")
    return recent.select("event_id", "file_name", "document_type", "status", "confidence", "timestamp")


TYPE_SQL = "coalesce(nullif(document_type, ''), nullif(status, ''), 'Unknown')"


@query(
    f"""
WITH {RECENT_SQL}
SELECT file_name AS file, {TYPE_SQL} AS type,
       CASE WHEN confidence <> 0 THEN regexp_replace(confidence::VARCHAR, '\\.0$', '') || '%' ELSE '—' END AS confidence,
       coalesce(method, '—') AS method, coalesce(destination, '—') AS destination, clock AS time
FROM recent
"""
)
def dashboard_table(spark, folder) -> DataFrame:
    return reports.dashboard_rows(reports.recent_results(records(spark, folder), "event_id", "ts"))


@query(
    f"""
WITH {RECORDS_SQL}
SELECT event_id, file_name AS file, {TYPE_SQL} AS type,
       regexp_replace(coalesce(confidence, 0)::VARCHAR, '\\.0$', '') || '%' AS confidence,
       coalesce(method, '—') AS method, coalesce(destination, status) AS destination, status,
       CASE WHEN time_taken <> 0 THEN regexp_replace(time_taken::VARCHAR, '\\.0$', '') ELSE '—' END || 's' AS time
FROM records
"""
)
def result_cards(spark, folder) -> DataFrame:
    return reports.result_card(records(spark, folder), "event_id")


@query(
    f"""
WITH {RECORDS_SQL}
SELECT event_id, '{{' || array_to_string(list_filter([
           '"file_name":"' || file_name || '"', '"document_type":"' || document_type || '"',
           '"confidence":' || confidence::VARCHAR, '"status":"' || status || '"'], lambda x: x IS NOT NULL), ',') || '}}' AS body
FROM records
"""
)
def result_json(spark, folder) -> DataFrame:
    body = reports.record_json("file_name", "document_type", "confidence", "status")
    return records(spark, folder).select("event_id", body.alias("body"))


def report_table(spark, folder) -> DataFrame:
    """A report row per file: unreadable ones as such, the others as unclassified."""
    readable = F.col("text").isNotNull()
    return files_with_text(spark, folder).select(
        F.col("arrival_seq").alias("seq"), "file_name",
        reports.size_kb(F.col("length")).alias("size_kb"), F.col("file_ext").alias("file_type"),
        F.lit("No").alias("is_duplicate"), F.when(readable, "Yes").otherwise("No").alias("is_readable"),
        F.when(readable, "Unknown").otherwise("Unreadable").alias("document_type"),
        F.lit("documents/unknown").alias("destination"), F.lit(0.25).alias("time_taken"),
        F.when(readable, "success").otherwise("unreadable").alias("status"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("arrival_seq")).alias("reported_at"),
    )


REPORTS_SQL = f"""
{FILES_SQL}, report_rows AS (
    SELECT arrival_seq AS seq, file_name, {sql_round('length / 1024.0::DOUBLE', 2)} AS size_kb, file_ext, readable,
           strftime(TIMESTAMP '2023-11-14 22:13:20' + to_seconds(arrival_seq), '%Y-%m-%d %H:%M:%S') AS logged
    FROM facts
), entries AS (
    SELECT seq, array_to_string(['', repeat('-', 50), 'PROCESSING REPORT - ' || logged, repeat('-', 50),
        'file name     : ' || file_name, 'file size     : ' || size_kb || ' KB', 'file type     : ' || file_ext,
        'duplicate     : No', 'readable      : ' || CASE WHEN readable THEN 'Yes' ELSE 'No' END,
        'document type : ' || CASE WHEN readable THEN 'Unknown' ELSE 'Unreadable' END,
        'destination   : documents/unknown', 'time taken    : 0.25 seconds',
        'status        : ' || CASE WHEN readable THEN 'success' ELSE 'unreadable' END, repeat('-', 50), ''], chr(10)) AS entry
    FROM report_rows
)"""


@query(f"WITH {REPORTS_SQL} SELECT seq, entry FROM entries")
def report_texts(spark, folder) -> DataFrame:
    report = report_table(spark, folder)
    return report.select("seq", reports.report_text(report).alias("entry"))


@query(f"WITH {REPORTS_SQL} SELECT seq, entry || chr(10) AS entry FROM entries")
def report_log(spark, folder) -> DataFrame:
    """Reports appended to the log in two runs and read back."""
    path = f"{shared_folder(spark)}/logs/{uuid.uuid4().hex}"
    report = report_table(spark, folder)
    logs.append_log(report.filter("is_readable = 'Yes'"), path)
    logs.append_log(report.filter("is_readable = 'No'"), path)
    return logs.read_log(spark, path)


@query("SELECT CAST(0 AS BIGINT) AS seq, 'no logs yet' AS entry WHERE (SELECT count(*) FROM documents WHERE text IS NULL) = 0")
def empty_log(spark, folder) -> DataFrame:
    """The log of documents without text, of which there are none."""
    missing = table(spark, folder, "documents").filter("text IS NULL")
    return logs.log_or_notice(missing.select(F.col("doc_id").alias("seq"), F.col("text").alias("entry")))


@query(
    """
SELECT user_id, event_id, event_type, value FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events
) WHERE n = 1
"""
)
def latest_per_user(spark, folder) -> DataFrame:
    events = table(spark, folder, "events").select("user_id", "event_id", "event_type", "value")
    return logs.latest_per_key(events, "user_id", "event_id")


@query(
    """
SELECT 'user' || user_id || '.txt' AS filename, event_id AS seq, event_type AS status FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events
) WHERE n = 1
"""
)
def keyed_items(spark, folder) -> DataFrame:
    """Items put in two writes, merged into one run."""
    path = f"{shared_folder(spark)}/items/{uuid.uuid4().hex}"
    items = table(spark, folder, "events").select(
        F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit(".txt")).alias("filename"),
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("status"),
    )
    logs.put_items(items.filter("status <> 'view'"), f"{path}/log")
    logs.put_items(items.filter("status = 'view'"), f"{path}/log")
    logs.compact_items(spark, f"{path}/log")
    return logs.read_items(spark, f"{path}/log")


@query(
    """
WITH keyed AS (
    SELECT event_id AS seq, 'in/' || (event_id % 5) || '/user' || user_id || '.txt' AS key,
           CASE event_type WHEN 'view' THEN 'Resume' WHEN 'click' THEN 'Invoice' WHEN 'signup' THEN 'unsupported' ELSE 'Unknown' END AS document_type
    FROM events
), placed AS (
    SELECT *, CASE document_type WHEN 'Resume' THEN 'hr/resumes/' WHEN 'Invoice' THEN 'finance/invoices/' ELSE 'unknown/' END
              || regexp_extract(key, '[^/]*$') AS dest_key FROM keyed
)
SELECT seq, key, document_type, dest_key FROM placed
QUALIFY row_number() OVER (PARTITION BY dest_key ORDER BY seq DESC) = 1
"""
)
def organised_objects(spark, folder) -> DataFrame:
    """Objects moved under their type; the later of two equal names overwrites the earlier."""
    kind = F.col("event_type")
    objects = table(spark, folder, "events").select(
        F.col("event_id").alias("seq"),
        F.concat(
            F.lit("in/"), (F.col("event_id") % 5).cast("string"), F.lit("/user"),
            F.col("user_id").cast("string"), F.lit(".txt"),
        ).alias("key"),
        F.when(kind == "view", "Resume").when(kind == "click", "Invoice").when(kind == "signup", "unsupported")
        .otherwise("Unknown").alias("document_type"),
    )
    return file_sink.organised_objects(objects)


@query(
    f"""
WITH {FILES_SQL}
SELECT CASE WHEN readable THEN 'documents/unknown' ELSE 'documents/miscellaneous/unreadable' END AS destination,
       count(*) AS files, CAST(sum(length) AS BIGINT) AS bytes, count(DISTINCT md5) AS contents
FROM facts GROUP BY 1
"""
)
def routed_folders(spark, folder) -> DataFrame:
    """Whole contents written by destination and read back."""
    path = f"{shared_folder(spark)}/routed/{uuid.uuid4().hex}"
    readable = F.col("text").isNotNull()
    placed = files_with_text(spark, folder).select(
        F.when(readable, "documents/unknown").otherwise("documents/miscellaneous/unreadable").alias("destination"),
        "file_name", "content",
    )
    file_sink.write_routed(placed, path)
    stored = spark.read.parquet(path)
    return stored.groupBy("destination").agg(
        F.count("*").alias("files"),
        F.sum(F.octet_length("content").cast("long")).alias("bytes"),
        F.countDistinct(F.md5("content")).alias("contents"),
    )
