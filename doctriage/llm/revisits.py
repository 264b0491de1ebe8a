"""Not-modified revisits: the response a 304 capture stands for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doctriage.llm.asof import carry_forward
from doctriage.llm.urls import canonical_url

FULL, NOT_MODIFIED = 200, 304

# Header fields a 304 response may update in the stored response.
PERMITTED = (
    "age",
    "cache-control",
    "content-location",
    "date",
    "etag",
    "expires",
    "last-modified",
    "vary",
)

RESOLVED = "resolved"
NO_RESPONSE = "no earlier response"
NO_VALIDATOR = "no validator"
MISMATCH = "validator mismatch"
NO_URL = "no url"


def lower_names(headers: Column) -> Column:
    """A header map with lower-case names; of names that differ in case only, the first counts."""
    headers = F.coalesce(headers, F.create_map().cast("map<string,string>"))
    names = F.array_distinct(F.transform(F.map_keys(headers), F.lower))
    entries = F.map_entries(headers)
    values = F.transform(
        names, lambda n: F.get(F.filter(entries, lambda e: F.lower(e["key"]) == n), F.lit(0))["value"]
    )
    return F.map_from_arrays(names, values)


def same_etag(left: Column, right: Column) -> Column:
    """Weak comparison: the mark for weak tags is left out."""
    bare = lambda tag: F.regexp_replace(F.trim(tag), r"^W/", "")
    return bare(left) == bare(right)


def merged_headers(stored: Column, update: Column) -> Column:
    """``stored`` with the permitted fields of ``update``; both have lower-case names."""
    fresh = F.map_filter(update, lambda name, value: name.isin(*PERMITTED) & value.isNotNull())
    rest = F.map_filter(stored, lambda name, value: ~F.array_contains(F.map_keys(fresh), name))
    return F.map_concat(rest, fresh)


def resolve(captures: DataFrame) -> DataFrame:
    """``capture_id, url, outcome, response_id, headers`` for every not-modified capture.

    ``captures`` has ``capture_id, url, fetched_at, status, headers`` (a map).  A revisit is joined
    to the latest full response of its canonical URL fetched strictly earlier (of several at one
    moment the one with the largest id).  It is resolved if the entity tags agree, or without a
    tag in the revisit the modification dates; then ``response_id`` names the response, whose
    headers are returned with the permitted fields of the revisit put in.  Otherwise the outcome
    says why not, and the other columns are null.

    A revisit without URL, or with a URL that has no host, is returned as ``no url``; without a time
    it follows nothing (``no earlier response``).  Full responses without URL or time are not used.
    Other statuses are ignored.  Repeated revisits are answered alike, each on its own row.
    Further columns are ignored, and an empty table gives an empty result.
    """
    rows = captures.select(
        F.col("capture_id").cast("long").alias("capture_id"),
        canonical_url(F.col("url")).alias("key"),
        "fetched_at",
        (F.col("status") == FULL).alias("full"),
        lower_names(F.col("headers")).alias("headers"),
    ).filter(F.col("status").isin(FULL, NOT_MODIFIED))
    stored = F.col("full") & F.col("fetched_at").isNotNull()
    # At one moment revisits come first, so that they see strictly earlier responses only.
    joined = carry_forward(
        rows.filter("key IS NOT NULL AND (fetched_at IS NOT NULL OR NOT full)"),
        "key",
        ["fetched_at", "full", "capture_id"],
        stored,
        ["capture_id", "headers"],
    ).filter("NOT full")
    own, found = F.col("headers"), F.col("carried.headers")
    tag, date = own["etag"], own["last-modified"]
    agrees = F.when(tag.isNotNull(), same_etag(tag, found["etag"])).otherwise(
        F.trim(date) == F.trim(found["last-modified"])
    )
    outcome = (
        F.when(F.col("carried").isNull(), NO_RESPONSE)
        .when(tag.isNull() & date.isNull(), NO_VALIDATOR)
        .when(F.coalesce(agrees, F.lit(False)), RESOLVED)
        .otherwise(MISMATCH)
    )
    fits = F.col("outcome") == RESOLVED
    answered = joined.withColumn("outcome", outcome).select(
        "capture_id",
        F.col("key").alias("url"),
        "outcome",
        F.when(fits, F.col("carried.capture_id")).alias("response_id"),
        F.when(fits, merged_headers(found, own)).alias("headers"),
    )
    lost = rows.filter("key IS NULL AND NOT full").select(
        "capture_id",
        F.col("key").alias("url"),
        F.lit(NO_URL).alias("outcome"),
        F.lit(None).cast("long").alias("response_id"),
        F.lit(None).cast("map<string,string>").alias("headers"),
    )
    return answered.unionByName(lost)


def with_payload(resolved: DataFrame, captures: DataFrame, columns: list[str]) -> DataFrame:
    """Add the payload ``columns`` of the responses that revisits were resolved to."""
    payload = captures.filter(F.col("status") == FULL).select(
        F.col("capture_id").alias("_payload_of"), *[F.col(c).alias(f"_{c}") for c in columns]
    )
    joined = resolved.join(payload, F.col("response_id") == F.col("_payload_of"), "left")
    return joined.select(*resolved.columns, *[F.col(f"_{c}").alias(c) for c in columns])
