"""State in hash buckets: what a run opens follows its files, not the history."""

from pyspark.sql import functions as F
from test_triage import GOOD, FixedModel, by_name, write

from doctriage.functions.paths import numbered_name
from doctriage.operators.naming import name_family
from doctriage.plans import local, runs
from doctriage.session import child_names, delete_path
from doctriage.sinks import state
from doctriage.sources.files import list_folder

SCHEMA = "name string, last long"


def rows(spark, cells):
    made = spark.createDataFrame(cells, SCHEMA)
    return made.withColumn("bucket", state.bucket(F.col("name")))


def test_many_runs_keep_few_files_and_lose_nothing(spark, tmp_path):
    path, expected = str(tmp_path / "state"), {}
    for run in range(25):
        cells = [(f"n{run % 7}", run), (f"own{run}", 1), (f"own{run}", 3)]
        for name, last in cells:
            expected[name] = max(last, expected.get(name, 0))
        state.put_state(rows(spark, cells), path, f"run={run:04d}", ("name",), "last", fan=3)
    every = rows(spark, [(name, 0) for name in expected])
    found = state.read_state(spark, path, SCHEMA, every).groupBy("name").agg(F.max("last").alias("last"))
    assert {r["name"]: r["last"] for r in found.collect()} == expected
    # One name opens one bucket: at most one file for each of the few runs of the few tiers.
    one = state.read_state(spark, path, SCHEMA, rows(spark, [("n3", 0)]))
    buckets = {part for file in one.inputFiles() for part in file.split("/") if part.startswith("bucket=")}
    assert len(buckets) == 1
    assert len(one.inputFiles()) <= 10 < len(found.inputFiles())
    assert one.filter("name = 'n3'").agg(F.max("last")).first()[0] == expected["n3"]


def test_a_run_put_twice_and_a_merge_made_twice_change_nothing(spark, tmp_path):
    path = str(tmp_path / "state")
    for run in (0, 1, 0, 2, 1):
        state.put_state(rows(spark, [("a", run), (f"b{run}", 5)]), path, f"run={run}", ("name",), "last", fan=2)
    delete_path(spark, f"{path}/tier=1/run=0..1/_SUCCESS")  # a merge that was stopped
    state.put_state(rows(spark, []), path, "run=3", ("name",), "last", fan=2)
    found = state.read_state(spark, path, SCHEMA, rows(spark, [("a", 0), ("b0", 0), ("b1", 0), ("b2", 0)]))
    held = {r["name"]: r["n"] for r in found.groupBy("name").agg(F.max("last").alias("n")).collect()}
    assert held == {"a": 2, "b0": 5, "b1": 5, "b2": 5}


def test_nothing_known(spark, tmp_path):
    path = str(tmp_path / "state")
    assert state.read_state(spark, path, SCHEMA, rows(spark, [("a", 0)])).isEmpty()
    state.put_state(rows(spark, []), path, "run=0", ("name",), "last")
    assert state.has_state(spark, path)
    assert state.read_state(spark, path, SCHEMA, rows(spark, [("a", 0)])).isEmpty()
    assert state.read_state(spark, path, SCHEMA, rows(spark, [])).isEmpty()


def test_a_family_holds_its_numbered_names(spark):
    names = ["a.pdf", "a", ".a", "a_1.pdf", "_1", "_1_2.pdf", "._5.txt", "..5", "a b_3.tar.gz", "a_12345678901234567890.pdf"]
    made = spark.createDataFrame([(n,) for n in names], "name string").withColumn("to", F.lit("x"))
    made = made.withColumn("copy", numbered_name(F.col("name"), F.lit(4)))
    made = made.withColumn("again", numbered_name(F.col("copy"), F.lit(2)))
    family = [name_family(F.col("to"), F.col(c)) for c in ("name", "copy", "again")]
    for row in made.select("name", *family).collect():
        assert row[1] == row[2] == row[3], row


def listed(spark, folder, names):
    return list_folder(spark, folder).filter(F.col("path").rlike(f"/({'|'.join(names)})$"))


def test_runs_by_buckets_equal_runs_that_read_all_results(spark, tmp_path, monkeypatch):
    settings = local.Settings(model=FixedModel())
    texts = {"a.txt": GOOD, "a_1.txt": GOOD + b" other", "b.mp4": b"two", "a_2.txt": GOOD + b" third", "c.txt": GOOD}
    uploads = write(tmp_path / "in", list(texts.items()))
    root, plain = str(tmp_path / "root"), str(tmp_path / "plain")
    opened = []
    monkeypatch.setattr(runs, "read_state", lambda *a: opened.append(state.read_state(*a)) or opened[-1])
    for names in (["a.txt"], ["a_1.txt", "b.mp4"], ["c.txt", "a_2.txt"], list(texts)):
        chosen = listed(spark, uploads, names)
        got = by_name(runs.run_folder(spark, uploads, root, settings, chosen))
        files = [len(table.inputFiles()) for table in opened]
        opened.clear()
        # The root that forgets its state makes it from the results.
        delete_path(spark, f"{plain}/state")
        assert got == by_name(runs.run_folder(spark, uploads, plain, settings, chosen))
        assert all(count <= 3 * len(names) for count in files)
        opened.clear()
    assert child_names(spark, f"{root}/state") and runs.results(spark, root).count() == len(texts)


def test_tables_without_rows_need_no_tasks(spark, tmp_path):
    known = state.read_state(spark, str(tmp_path / "state"), SCHEMA, rows(spark, [("a", 0)]))
    assert known.isEmpty() and known.dtypes == [("name", "string"), ("last", "bigint")]
    given = spark.range(5).select(F.col("id").cast("string").alias("name"))
    joined = given.join(known, "name", "left_anti")
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "ExistingRDD" not in plan
    assert {r["name"] for r in joined.collect()} == set("01234")
    stored = runs.results(spark, str(tmp_path / "none"))
    assert stored.isEmpty() and stored.schema.names == local.RESULT_SCHEMA.names
