"""Key lookups and running counts that stay balanced when one key holds a third of all rows."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOT_KEYS = 1000
SCATTER = 100_000
MAX_WINDOW_ROWS = 1_000_000
BROADCAST_KEYS = 500_000


def matching(table: DataFrame, keys: DataFrame, key: str, count: int) -> DataFrame:
    """Rows of a large ``table`` whose ``key`` is among ``keys``, of which there are at most ``count``.

    Few keys are broadcast, so that the table is only scanned; many are joined by shuffle.
    """
    side = F.broadcast(keys) if count <= BROADCAST_KEYS else keys
    return table.join(side, key, "left_semi")


def join_facts(rows: DataFrame, facts: DataFrame, key: str, copies: str) -> DataFrame:
    """Left-join ``facts`` (one row per string key, ``copies`` = how often it occurs) to ``rows``.

    The ``HOT_KEYS`` keys most frequent among ``rows`` are broadcast, with their facts if they have
    any: a bound that does not grow with the data.  Their rows, and rows without a key, then carry a
    scattered second join key, so the shuffle join that serves all other keys receives no large
    group.  Every row is answered by exactly one of the two joins.
    """
    values = [name for name in facts.columns if name not in (key, copies)]
    known = facts.filter(F.col(key).isNotNull()).select(
        F.col(key).alias("_known"), F.col(copies).alias("_copies"), F.struct(*values).alias("_values")
    )
    frequent = rows.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_hot_key")).count()
    frequent = frequent.orderBy(F.desc("count"), "_hot_key").limit(HOT_KEYS).select("_hot_key")
    hot = frequent.join(known, frequent["_hot_key"] == known["_known"], "left")
    hot = hot.select("_hot_key", F.col("_values").alias("_hot"))
    # The coalesce keeps the key non-null for the optimizer, which would otherwise push a null
    # filter below the aggregation and so keep the two uses from sharing it.
    own = F.coalesce(F.concat(F.lit("k"), "_known"), F.lit(""))
    cold = known.filter("_copies > 0").select(own.alias("_at"), F.col("_values").alias("_cold"))
    scattered = F.pmod(F.xxhash64(*rows.columns), F.lit(SCATTER)).cast("string")
    own_key = F.col("_hot_key").isNull() & F.col(key).isNotNull()
    at = F.when(own_key, F.concat(F.lit("k"), key)).otherwise(F.concat(F.lit("h"), scattered))
    joined = (
        rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
        .withColumn("_at", at)
        .join(cold, "_at", "left")
    )
    return joined.select(
        *rows.columns,
        *[F.coalesce(F.col(f"_hot.{name}"), F.col(f"_cold.{name}")).alias(name) for name in values],
    )


def count_before(
    rows: DataFrame,
    keys: list[str],
    order: str,
    counted: str,
    result: str,
    max_window_rows: int = MAX_WINDOW_ROWS,
) -> DataFrame:
    """Add ``result``: how many ``counted`` rows of the same group precede each row.

    Groups known to be small use one window.  Otherwise the order column is cut at approximate
    quantiles, each (group, slice) is counted on its own and gets the sum of its earlier slices
    as offset.  The cuts only balance the work; any cuts give the same counts.
    """
    weight = F.col(counted).cast("long")
    ahead = (Window.unboundedPreceding, -1)
    total = largest = rows.count()
    if total > max_window_rows:
        largest = rows.groupBy(*keys).count().agg(F.max("count")).first()[0]
    if largest <= max_window_rows:
        window = Window.partitionBy(*keys).orderBy(order).rowsBetween(*ahead)
        return rows.withColumn(result, F.coalesce(F.sum(weight).over(window), F.lit(0)))

    pieces = max(2, math.ceil(total / max_window_rows))
    position = F.col(order).cast("double")
    shares = [i / pieces for i in range(1, pieces)]
    cuts = rows.agg(F.percentile_approx(position, shares, 10_000)).first()[0]
    splits = [-math.inf, *sorted(set(cuts)), math.inf]
    sliced = Bucketizer(splits=splits, inputCol="_position", outputCol="_slice").transform(
        rows.withColumn("_position", position)
    )
    offsets = (
        sliced.groupBy(*keys, "_slice")
        .agg(F.sum(weight).alias("_n"))
        .withColumn(
            "_offset",
            F.coalesce(
                F.sum("_n").over(Window.partitionBy(*keys).orderBy("_slice").rowsBetween(*ahead)),
                F.lit(0),
            ),
        )
        .drop("_n")
    )
    window = Window.partitionBy(*keys, "_slice").orderBy(order).rowsBetween(*ahead)
    return (
        sliced.withColumn("_local", F.coalesce(F.sum(weight).over(window), F.lit(0)))
        .join(offsets, [*keys, "_slice"])
        .withColumn(result, F.col("_offset") + F.col("_local"))
        .select(*rows.columns, result)
    )
