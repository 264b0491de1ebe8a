"""Destinations, outcomes and arrival verification."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doctriage import fixed
from doctriage.functions.numbers import lookup
from doctriage.functions.paths import base_name, is_supported
from doctriage.operators.validation import is_non_document


def destination(label: Column, routes: Mapping[str, str] = fixed.ROUTES) -> Column:
    return lookup(label, routes, fixed.DEFAULT_ROUTE)


def cloud_prefix(label: Column, prefixes: Mapping[str, str] = fixed.CLOUD_PREFIXES) -> Column:
    return lookup(label, prefixes, fixed.DEFAULT_PREFIX)


def destination_key(label: Column, key: Column) -> Column:
    """Object key of a sorted file: folder prefix and base name."""
    return F.concat(cloud_prefix(label), base_name(key))


def outcome(
    length: Column, is_duplicate: Column, readable: Column, ext: Column, has_model: bool
) -> Column:
    """Name of the outcome a file reaches, first match wins."""
    return (
        F.when(length == 0, "rejected")
        .when(is_duplicate, "duplicate")
        .when(~readable & is_supported(ext), "unreadable")
        .when(~readable, "unsupported")
        .when(is_non_document(ext), "non-document")
        .otherwise(F.lit("classified" if has_model else "error"))
    )


def registerable(readable: Column, ext: Column, length: Column, has_model: bool) -> Column:
    """Whether a file that is no duplicate enters the registry of seen contents."""
    classified = F.lit(has_model) | is_non_document(ext)
    return (length > 0) & readable & classified


# Per outcome: result status, report type, report duplicate, report readable, folder, report
# folder, report status.  None: taken from the classification, or absent for "error".
OUTCOMES = {
    "rejected": (
        "rejected", "Rejected", "No", "No",
        fixed.UNREADABLE_FOLDER, fixed.REJECTED_REPORT_FOLDER, "rejected",
    ),
    "duplicate": (
        "duplicate", "Duplicate", "Yes", "No",
        fixed.DUPLICATES_FOLDER, fixed.DUPLICATES_FOLDER, "duplicate",
    ),
    "unreadable": (
        "unreadable", "Unreadable", "No", "No",
        fixed.UNREADABLE_FOLDER, fixed.UNREADABLE_FOLDER, "unreadable",
    ),
    "unsupported": (
        "unsupported", "Unsupported", "No", "No",
        fixed.UNSUPPORTED_FOLDER, fixed.UNSUPPORTED_FOLDER, "unsupported",
    ),
    "non-document": (
        "success", fixed.UNKNOWN, "No", "Yes",
        fixed.DEFAULT_ROUTE, fixed.DEFAULT_ROUTE, fixed.NON_DOCUMENT_STATUS,
    ),
    "error": ("error", None, None, None, None, None, None),
    "classified": ("success", None, "No", "Yes", None, None, "success"),
}
OUTCOME_FIELDS = (
    "status", "report_type", "report_duplicate", "report_readable",
    "destination", "report_destination", "report_status",
)


def with_outcome_columns(
    files: DataFrame, routes: Mapping[str, str] = fixed.ROUTES, label: str = "document_type"
) -> DataFrame:
    """Add all columns an outcome decides to rows with ``outcome`` and ``label``."""
    routed = destination(F.col(label), routes)
    own = {"report_type": F.col(label), "destination": routed, "report_destination": routed}
    added = []
    for position, field in enumerate(OUTCOME_FIELDS):
        values = {name: row[position] for name, row in OUTCOMES.items() if row[position]}
        chain = F.when(F.lit(False), F.lit(None).cast("string"))
        for name, value in values.items():
            chain = chain.when(F.col("outcome") == name, F.lit(value))
        if field in own:
            chain = chain.when(F.col("outcome") == "classified", own[field])
        added.append(chain.alias(field))
    return files.select("*", *added)


def verify_arrival(plan: DataFrame, listing: DataFrame) -> DataFrame:
    """Set ``status`` and ``report_status`` of classified rows by what the sink really holds.

    ``listing`` has ``destination`` and ``final_name``; both sides are unique on that pair.
    """
    found = listing.select("destination", "final_name").distinct().withColumn("arrived", F.lit(True))
    checked = plan.join(found, ["destination", "final_name"], "left").fillna(False, ["arrived"])
    missed = (F.col("outcome") == "classified") & ~F.col("arrived")
    for field in ("status", "report_status"):
        checked = checked.withColumn(field, F.when(missed, F.lit("failed")).otherwise(F.col(field)))
    return checked.select(*plan.columns, "arrived")


def not_arrived(plan: DataFrame, listing: DataFrame) -> DataFrame:
    """Planned files the sink does not hold."""
    keys = ["destination", "final_name"]
    return plan.join(listing.select(*keys), keys, "left_anti")
