"""Ordered duplicates against a file-by-file model, and hot contents."""

import random

import pytest
from pyspark.sql import functions as F

from doctriage.operators import skew
from doctriage.operators.duplicates import add_to_registry, mark_duplicates, not_seen_before, seen_before

SCHEMA = "arrival_seq long, md5 string, length long, registerable boolean"


def sequential(files, known):
    seen, marks = set(known), {}
    for seq, md5, length, registers in sorted(files):
        marks[seq] = length > 0 and md5 in seen
        if registers and length > 0:
            seen.add(md5)
    return marks


@pytest.mark.parametrize("hot_keys", [1000, 2, 0])
def test_matches_sequential_rule(spark, monkeypatch, hot_keys):
    monkeypatch.setattr(skew, "HOT_KEYS", hot_keys)
    rng = random.Random(5)
    files = []
    for seq in rng.sample(range(10_000), 1500):
        # A third of all files share one content.
        md5 = "hot" if rng.random() < 0.34 else f"m{rng.randrange(400)}"
        files.append((seq, md5, rng.choice([0, 5, 9]), rng.random() < 0.4))
    known = [f"m{i}" for i in range(0, 400, 7)]
    df = spark.createDataFrame(files, SCHEMA)
    registry = spark.createDataFrame([(k,) for k in known + known], "md5 string")
    alone = mark_duplicates(df).select("arrival_seq", "is_duplicate").collect()
    assert dict(map(tuple, alone)) == sequential(files, [])
    against = mark_duplicates(df, registry).select("arrival_seq", "is_duplicate").collect()
    assert dict(map(tuple, against)) == sequential(files, known)


def test_registry_sets(spark):
    files = spark.createDataFrame([("a", True), ("b", False), ("c", True)], "md5 string, registered boolean")
    registry = spark.createDataFrame([("a",), ("x",)], "md5 string")
    assert {r.md5 for r in seen_before(files, registry).collect()} == {"a"}
    assert {r.md5 for r in not_seen_before(files, registry).collect()} == {"b", "c"}
    assert sorted(r.md5 for r in add_to_registry(registry, files).collect()) == ["a", "c", "x"]


@pytest.mark.parametrize("limit", [10_000, 50])
def test_count_before_splits_hot_groups(spark, limit):
    rng = random.Random(9)
    rows = [(rng.choice(["h", "h", "a", "b"]), seq, rng.random() < 0.7) for seq in rng.sample(range(10**6), 800)]
    expected, running = {}, {}
    for key, seq, counts in sorted(rows, key=lambda r: r[1]):
        expected[seq] = running.get(key, 0)
        running[key] = running.get(key, 0) + counts
    df = spark.createDataFrame(rows, "k string, seq long, c boolean")
    got = skew.count_before(df, ["k"], "seq", "c", "n", max_window_rows=limit)
    assert {r.seq: r.n for r in got.collect()} == expected


def test_hot_rows_do_not_meet_in_one_partition(spark):
    """Rows of a broadcast key carry scattered join keys through the shuffle join."""
    rows = spark.range(20_000).select(
        F.col("id").alias("seq"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k")
    )
    facts = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = skew.join_facts(rows, facts, "k", "n")
        sizes = joined.groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert joined.filter("k = 'hot'").select("first").distinct().count() == 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    counts = [r["count"] for r in sizes]
    assert sum(counts) == 20_000 and max(counts) < 20_000 / 8 * 1.5
