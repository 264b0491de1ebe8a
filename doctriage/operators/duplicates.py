"""Content fingerprints and duplicates in arrival order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doctriage.operators.skew import join_facts, matching


def fingerprint(content: Column) -> Column:
    """MD5 of the raw bytes as 32 lower-case hex digits; independent of the file name."""
    return F.md5(content)


def mark_duplicates(
    files: DataFrame, registry: DataFrame | None = None, order: str = "arrival_seq"
) -> DataFrame:
    """Add ``is_duplicate`` to rows with ``md5``, ``length``, ``registerable`` and ``order``.

    A non-empty file is a duplicate when an earlier file with the same content was registered,
    in this set or in ``registry``.  Rejected, unreadable and unsupported files never register,
    so a plain distinct on the fingerprint would be wrong.

    Each content is reduced to its first registered arrival before any row is joined; contents
    that cannot cause a duplicate are dropped from the lookup.  ``files`` is read several times:
    pass narrow, staged rows.  A registry that is large against ``files`` is scanned, not shuffled.
    """
    contents = (
        files.filter("length > 0")
        .groupBy("md5")
        .agg(
            F.min(F.when(F.col("registerable"), F.col(order))).alias("first_registered"),
            F.count("*").alias("copies"),
        )
    )
    if registry is None:
        contents = contents.withColumn("seen", F.lit(False))
    else:
        arrived = files.filter("length > 0").select("md5").distinct()
        known = matching(registry.select("md5"), arrived, "md5", files.count()).distinct()
        contents = contents.join(known.withColumn("seen", F.lit(True)), "md5", "left")
        contents = contents.fillna(False, ["seen"])
    causes = contents.filter(
        F.col("seen") | ((F.col("copies") > 1) & F.col("first_registered").isNotNull())
    )
    marked = join_facts(files, causes, "md5", "copies")
    repeated = F.col("seen") | (F.col(order) > F.col("first_registered"))
    return marked.withColumn(
        "is_duplicate", (F.col("length") > 0) & F.coalesce(repeated, F.lit(False))
    ).drop("first_registered", "seen")


def seen_before(files: DataFrame, registry: DataFrame) -> DataFrame:
    """Files whose content is registered already (the test alone, without arrival order)."""
    known = registry.select("md5").distinct()
    return files.join(known, "md5", "left_semi")


def not_seen_before(files: DataFrame, registry: DataFrame) -> DataFrame:
    known = registry.select("md5").distinct()
    return files.join(known, "md5", "left_anti")


def add_to_registry(registry: DataFrame, results: DataFrame) -> DataFrame:
    """Set union of the registry with the contents that ``results`` registered."""
    added = results.filter("registered").select("md5")
    return registry.select("md5").unionByName(added).distinct()
