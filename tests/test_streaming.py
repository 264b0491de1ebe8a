"""Arrivals in micro-batches: replays, running state and equality with one batch."""

import random

from pyspark.sql import functions as F

from doctriage.plans import local
from doctriage.streaming import arrivals

SCHEMA = "arrival_seq long, path string, file_name string, file_ext string, length long, md5 string, text string"


def files(count=120):
    rng = random.Random(2)
    rows = []
    for seq in range(count):
        name, ext = rng.choice([("a", ".pptx"), ("a_1", ".pptx"), ("b", ".txt"), ("c", ".mp4")])
        body = rng.choice(["x", "y", "z", "w"]) * 12
        text = None if ext == ".mp4" or body[0] == "w" else body
        rows.append((seq, f"in/{name}{ext}", name + ext, ext, len(body), body, text))
    return rows


def run(spark, root, batches, **settings):
    """Each batch arrives and is handled by a stream restarted from the same checkpoint."""
    for batch in batches:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/in")
        source = spark.readStream.schema(SCHEMA).parquet(f"{root}/in")
        arrivals.start(source, local.Settings(), f"{root}/out", f"{root}/check", **settings).awaitTermination()
    return arrivals.read_results(spark, f"{root}/out")


def shown(results):
    return sorted(tuple(r) for r in results.select("arrival_seq", "outcome", "final_name", "registered").collect())


def test_batches_equal_one_batch(spark, tmp_path):
    rows = files()
    expected = shown(local.triage(spark.createDataFrame(rows, SCHEMA), local.Settings()))
    results = run(spark, tmp_path, [rows[:50], rows[50:60], rows[60:]])
    assert shown(results) == expected
    assert results.select("batch_id").distinct().count() == 3


def test_replayed_batch_does_not_see_itself(spark, tmp_path):
    rows = files()
    first, second = rows[:70], rows[70:]
    before = shown(run(spark, tmp_path, [first, second]))
    past = arrivals.read_results(spark, f"{tmp_path}/out").filter("batch_id < 1")
    again = local.triage(
        spark.createDataFrame(second, SCHEMA),
        local.Settings(),
        past.filter("registered").select("md5"),
        arrivals.name_state(past),
    )
    again.write.mode("overwrite").parquet(f"{tmp_path}/out/batch_id=1")
    assert shown(arrivals.read_results(spark, f"{tmp_path}/out")) == before


def test_folder_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_bytes(b"a readable text file")
    (folder / "b.txt").write_bytes(b"a readable text file")
    source = arrivals.stream_folder(spark, str(folder))
    query = arrivals.start(
        source, local.Settings(), f"{tmp_path}/out", f"{tmp_path}/check", prepare=local.read_texts
    )
    query.awaitTermination()
    results = arrivals.read_results(spark, f"{tmp_path}/out")
    assert sorted(r.file_name for r in results.collect()) == ["a.txt", "b.txt"]
    assert results.filter("outcome = 'error'").count() == 2
    moment = F.lit("2024-01-01 10:00:00").cast("timestamp")
    latest = arrivals.latest_results(spark, f"{tmp_path}/out", moment).collect()
    assert len(latest) == 2 and latest[0].timestamp == "10:00:00"


def test_updates_over_several_batches(spark, tmp_path):
    rows = [("a", 1, "x"), ("b", 2, "y"), ("a", 5, "z"), ("a", 3, "w"), ("c", 9, "v")]
    schema = "k string, seq long, v string"
    for part in (rows[:2], rows[2:4], rows[4:]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        latest = arrivals.latest_stream(source, "k", "seq")
        arrivals.keep_updates(latest, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    got = arrivals.read_updates(spark, f"{tmp_path}/out", "k").select("k", "seq", "v").collect()
    assert sorted(map(tuple, got)) == [("a", 5, "z"), ("b", 2, "y"), ("c", 9, "v")]


def test_snapshots_stand_for_all_earlier_batches(spark, tmp_path):
    rows = files(90)
    expected = shown(local.triage(spark.createDataFrame(rows, SCHEMA), local.Settings()))
    parts = [rows[at : at + 18] for at in range(0, 90, 18)]
    assert shown(run(spark, tmp_path, parts, snapshot_every=2)) == expected
    kept = sorted(p.name for p in (tmp_path / "out_state").iterdir())
    assert kept == ["before=2", "before=4"]
    registry, names = arrivals.state_before(spark, f"{tmp_path}/out", 5, 2)
    assert not any("batch_id=0" in f or "batch_id=3" in f for f in registry.inputFiles() + names.inputFiles())
