"""Object-created events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doctriage.functions.paths import base_name, decode_key, file_ext

EVENT_SCHEMA = (
    "Records array<struct<s3:struct<bucket:struct<name:string>,object:struct<key:string>>>>"
)


def parse_events(events: DataFrame, body: str = "body", first_record_only: bool = False) -> DataFrame:
    """One row per record with ``bucket, key, filename, file_ext`` and the other event columns.

    ``first_record_only`` takes just the first record of each event.
    """
    others = [name for name in events.columns if name != body]
    parsed = events.select(*others, F.from_json(body, EVENT_SCHEMA)["Records"].alias("records"))
    if first_record_only:
        record = parsed.select(*others, F.get("records", F.lit(0)).alias("record"), F.lit(0).alias("record_ord"))
    else:
        record = parsed.select(*others, F.posexplode("records").alias("record_ord", "record"))
    key = decode_key(F.col("record.s3.object.key"))
    return (
        record.filter(F.col("record").isNotNull())
        .withColumn("bucket", F.col("record.s3.bucket.name"))
        .withColumn("key", key)
        .withColumn("filename", base_name(F.col("key")))
        .withColumn("file_ext", file_ext(F.col("filename")))
        .drop("record")
    )
