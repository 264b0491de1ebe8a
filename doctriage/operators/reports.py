"""Report rows, their text form, logs and result records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doctriage import fixed
from doctriage.functions.numbers import first_truthy, number_text, round_half_even, size_kb
from doctriage.functions.paths import join_path
from doctriage.functions.times import clock_time, log_time


def report_rows(results: DataFrame, time_taken: Column, reported_at: Column) -> DataFrame:
    """One report row per logged result; the error outcome logs nothing."""
    return results.filter(F.col("report_status").isNotNull()).select(
        F.col("arrival_seq").alias("seq"),
        "file_name",
        size_kb(F.col("length")).alias("size_kb"),
        F.col("file_ext").alias("file_type"),
        F.col("report_duplicate").alias("is_duplicate"),
        F.col("report_readable").alias("is_readable"),
        F.col("report_type").alias("document_type"),
        F.col("report_destination").alias("destination"),
        time_taken.cast("double").alias("time_taken"),
        F.col("report_status").alias("status"),
        reported_at.alias("reported_at"),
    )


def report_text(report: DataFrame) -> Column:
    """The text block of one report row, with an empty line before and a newline at the end."""
    values = [F.col(name) for name in (
        "file_name", "size_kb", "file_type", "is_duplicate", "is_readable",
        "document_type", "destination", "time_taken", "status",
    )]
    lines = [F.lit(""), F.lit(fixed.REPORT_RULE)]
    lines.append(F.concat(F.lit(fixed.REPORT_TITLE), log_time(F.col("reported_at"))))
    lines.append(F.lit(fixed.REPORT_RULE))
    for (label, unit), value in zip(fixed.REPORT_FIELDS, values):
        lines.append(F.concat(F.lit(f"{label:<14}: "), value.cast("string"), F.lit(unit)))
    lines.append(F.lit(fixed.REPORT_RULE))
    lines.append(F.lit(""))
    return F.array_join(F.array(*lines), "\n")


def log_lines(report: DataFrame, *keys: str) -> DataFrame:
    """``seq, entry`` and further ``keys``: what the log gains per report."""
    return report.select(*keys, "seq", F.concat(report_text(report), F.lit("\n")).alias("entry"))


def result_records(results: DataFrame) -> DataFrame:
    """Results as the caller of a single file sees them: only what its outcome reports."""
    path = join_path(F.col("destination"), F.col("final_name"))
    full = F.col("outcome").isin("classified", "non-document")
    placed = full | F.col("outcome").isin("duplicate", "unreadable", "unsupported")
    return results.select(
        "arrival_seq",
        "status",
        F.when(full, F.col("file_name")).alias("file_name"),
        F.when(full, F.col("document_type")).alias("document_type"),
        F.when(full, F.col("confidence")).alias("confidence"),
        F.when(placed, path).alias("destination"),
        F.when(full, F.col("method")).alias("method"),
    )


def record_json(*columns: str) -> Column:
    """The named columns as one JSON object; absent fields are left out."""
    return F.to_json(F.struct(*columns))


def recent_results(
    records: DataFrame, order: str | list[str], moment: str, limit: int = fixed.RECENT_RESULTS
) -> DataFrame:
    """The newest records, by one column or by several in turn, with their clock time."""
    return (
        records.orderBy(*[F.desc(name) for name in ([order] if isinstance(order, str) else order)])
        .limit(limit)
        .withColumn("timestamp", clock_time(F.col(moment)))
    )


def display_type(document_type: Column, status: Column) -> Column:
    return F.coalesce(first_truthy(document_type, status), F.lit("Unknown"))


def dashboard_rows(recent: DataFrame) -> DataFrame:
    """Table cells with a dash for absent values; confidence 0 counts as absent here."""
    dash = F.lit("—")
    confidence = F.when(
        F.col("confidence") != 0, F.concat(number_text_js(F.col("confidence")), F.lit("%"))
    )
    return recent.select(
        F.coalesce(first_truthy(F.col("file_name")), dash).alias("file"),
        display_type(F.col("document_type"), F.col("status")).alias("type"),
        F.coalesce(confidence, dash).alias("confidence"),
        F.coalesce(first_truthy(F.col("method")), dash).alias("method"),
        F.coalesce(first_truthy(F.col("destination")), dash).alias("destination"),
        F.coalesce(first_truthy(F.col("timestamp")), dash).alias("time"),
    )


def result_card(records: DataFrame, *keys: str) -> DataFrame:
    """Cells of the single-result card; here confidence 0 shows as ``0%``, but a time of 0 as absent."""
    dash = F.lit("—")
    seconds = F.when(F.col("time_taken") != 0, number_text_js(F.col("time_taken")))
    shown = display_type(F.col("document_type"), F.col("status"))
    return records.select(
        *keys,
        F.col("file_name").alias("file"),
        shown.alias("type"),
        F.concat(number_text_js(F.coalesce("confidence", F.lit(0.0))), F.lit("%")).alias("confidence"),
        F.coalesce(first_truthy(F.col("method")), dash).alias("method"),
        F.coalesce(first_truthy(F.col("destination"), F.col("status")), dash).alias("destination"),
        F.concat(F.coalesce(seconds, dash), F.lit("s")).alias("time"),
        F.coalesce(first_truthy(F.col("status")), dash).alias("status"),
    )


def number_text_js(value: Column) -> Column:
    """Number text without a trailing ``.0``."""
    return F.regexp_replace(number_text(value), r"\.0$", "")


def cloud_log_rows(results: DataFrame, time_taken: Column, logged_at: Column) -> DataFrame:
    """Key-value log items of the cloud flow; every value is text.

    An unsupported file logs its own fixed values; a failed move still logs success.
    """
    bad = F.col("status") == "unsupported"
    confidence = round_half_even(F.col("confidence"), 1)
    return results.select(
        "seq",
        "filename",
        F.when(bad, F.lit("Unsupported")).otherwise(F.col("document_type")).alias("document_type"),
        F.when(bad, F.lit("0")).otherwise(number_text(confidence)).alias("confidence"),
        F.when(bad, F.lit(fixed.CLOUD_UNSUPPORTED_FOLDER))
        .otherwise(F.coalesce(F.col("dest_key"), F.lit("unknown")))
        .alias("destination"),
        F.when(bad, F.lit("0")).otherwise(number_text(time_taken)).alias("time_taken"),
        log_time(logged_at).alias("timestamp"),
        F.when(bad, F.lit("unsupported")).otherwise(F.lit("success")).alias("status"),
    )
