"""Runs that are stopped at any point and then run again."""

import pytest
from pyspark.sql import functions as F
from test_triage import GOOD, FixedModel, by_name, write

from doctriage.plans import cloud, local, runs
from doctriage.session import child_names
from doctriage.sinks import logs
from doctriage.sources import files as files_source
from doctriage.sources.files import list_folder


class Stopped(Exception):
    pass


def stop(*_, **__):
    raise Stopped


def state(root):
    """Every file of the sink with its bytes."""
    base = root / "documents"
    return {str(p.relative_to(base)): p.read_bytes() for p in base.rglob("*") if p.is_file()}


UPLOADS = [("a.mp4", b"one"), ("b.mp4", b"two"), ("c.txt", GOOD), ("d.txt", b""), ("e.txt", GOOD)]


def half(copy):
    def run(plan, *rest):
        copy(plan.filter("final_name < 'c'"), *rest).count()
        raise Stopped

    return run


@pytest.mark.parametrize("point", ["planning", "plan written", "half copied", "copied", "results written", "totals written"])
def test_a_stopped_folder_run_is_finished_by_the_next(spark, tmp_path, monkeypatch, point):
    settings = local.Settings(model=FixedModel())
    uploads = write(tmp_path / "in", UPLOADS)
    whole = tmp_path / "whole"
    expected = by_name(runs.run_folder(spark, uploads, str(whole), settings))
    root = tmp_path / "root"
    with monkeypatch.context() as patch:
        if point == "planning":
            patch.setattr(runs, "triage_folder", stop)
        elif point == "plan written":
            patch.setattr(runs, "copy_files", stop)
        elif point == "half copied":
            patch.setattr(runs, "copy_files", half(runs.copy_files))
        elif point == "copied":
            patch.setattr(runs, "verified", stop)
        elif point == "results written":
            patch.setattr(runs.metrics, "totals", stop)
        else:
            patch.setattr(runs, "delete_path", stop)
        with pytest.raises(Stopped):
            runs.run_folder(spark, uploads, str(root), settings)
    before = runs.results(spark, str(root)).count()
    assert before == 0  # an open run is not read
    again = runs.run_folder(spark, uploads, str(root), settings).count()
    assert again == (len(UPLOADS) if point == "planning" else 0)
    got = by_name(runs.results(spark, str(root)))
    shown = ("status", "outcome", "destination", "final_name", "report_status")
    assert {n: [r[c] for c in shown] for n, r in got.items()} == {n: [r[c] for c in shown] for n, r in expected.items()}
    assert state(root) == state(whole) and len(state(root)) == len(UPLOADS)
    assert runs.log(spark, str(root)).count() == len(UPLOADS) == runs.summary(spark, str(root))[1].first().total
    assert runs.open_runs(spark, str(root)) == [] and not list(root.rglob("parts"))
    assert runs.run_folder(spark, uploads, str(root), settings).count() == 0


def test_foreign_names_are_looked_up(spark, tmp_path):
    root = tmp_path / "root"
    place = root / "documents/miscellaneous/unsupported"
    place.mkdir(parents=True)
    for name in ("a.mp4", *(f"a_{i}.mp4" for i in range(1, 9))):
        (place / name).write_bytes(b"foreign")
    uploads = write(tmp_path / "in", [("a.mp4", b"x"), ("b.mp4", b"y")])
    got = by_name(runs.run_folder(spark, uploads, str(root), local.Settings()))
    assert (got["a.mp4"].final_name, got["b.mp4"].final_name) == ("a_9.mp4", "b.mp4")
    assert (place / "a_9.mp4").read_bytes() == b"x" and (place / "a.mp4").read_bytes() == b"foreign"


def test_folders_are_listed_by_tasks(spark, tmp_path):
    top = tmp_path / "a b" / "top"
    (top / "x" / "deep er").mkdir(parents=True)
    (top / "empty").mkdir()
    for name in ("1", ".hidden", "_under", "x/2%20", "x/deep er/3#", "x/deep er/ü"):
        (top / name).write_bytes(name.encode())
    (top / "link").symlink_to(top / "1")
    (top / "loop").symlink_to(top)
    found = {r.path: r.length for r in list_folder(spark, str(top), below=True).collect()}
    names = ["1", ".hidden", "_under", "link", "x/2%20", "x/deep er/3#", "x/deep er/ü"]
    assert found == {f"file:{top}/{n}": (1 if n == "link" else len(n.encode())) for n in names}
    assert {r.path for r in list_folder(spark, str(top)).collect()} == {f"file:{top}/{n}" for n in names[:4]}
    assert list_folder(spark, str(tmp_path / "none"), below=True).count() == 0


def test_the_driver_lists_no_folder_of_the_sink(spark, tmp_path, monkeypatch):
    uploads, root = write(tmp_path / "in", UPLOADS), str(tmp_path / "root")
    listed, names = [], child_names
    monkeypatch.setattr(runs, "child_names", lambda spark, path: listed.append(path) or names(spark, path))
    # Folders are listed in the tasks' own processes; in the driver's nothing may list one.
    monkeypatch.setattr(files_source, "_entries", lambda folder: listed.append(folder) or iter(()))
    runs.run_folder(spark, uploads, root, local.Settings())
    assert {path.rpartition("/")[2] for path in listed} <= {"journal", "results"}


def stored(tmp_path, names=("a.txt", "b.txt", "b.txt")):
    rows = []
    for at, name in enumerate(names):
        place = tmp_path / "store/intake" / str(at)
        place.mkdir(parents=True)
        (place / name).write_bytes(b"readable text number %d" % at)
        rows.append((at, "intake", f"{at}/{name}", name))
    return rows


EVENTS = "seq long, bucket string, key string, filename string"


@pytest.mark.parametrize("point", ["plan written", "copied", "results written", "log written", "half removed"])
def test_a_stopped_cloud_run_and_events_that_come_again(spark, tmp_path, monkeypatch, point):
    events = spark.createDataFrame(stored(tmp_path), EVENTS)
    store, root = str(tmp_path / "store"), str(tmp_path / "root")

    def half_removed(plan):
        remove(plan.limit(1)).count()
        raise Stopped

    remove, copy = cloud.remove_objects, cloud.copy_objects

    def copied(*arguments):
        copy(*arguments).count()
        raise Stopped

    with monkeypatch.context() as patch:
        name, value = {
            "plan written": ("copy_objects", stop),
            "copied": ("copy_objects", copied),
            "results written": ("put_items", stop),
            "log written": ("remove_objects", stop),
            "half removed": ("remove_objects", half_removed),
        }[point]
        patch.setattr(cloud, name, value)
        with pytest.raises(Stopped):
            cloud.run_events(spark, events, store, root)
    if point in ("plan written", "copied"):
        assert len(list((tmp_path / "store").rglob("*.txt"))) == 3  # nothing is removed before results exist
    for _ in range(2):  # the events are delivered again, twice
        got = cloud.run_events(spark, events, store, root).collect()
        assert sorted((r.seq, r.status, r.moved, r.dest_key) for r in got) == [
            (0, "success", True, "unknown/a.txt"), (1, "success", True, "unknown/b.txt"), (2, "success", True, "unknown/b.txt"),
        ]
    organised = {p.name: p.read_bytes() for p in (tmp_path / "root/organised").rglob("*.txt")}
    assert organised == {"a.txt": b"readable text number 0", "b.txt": b"readable text number 2"}
    assert not list((tmp_path / "store").rglob("*.txt")) and cloud.open_runs(spark, root) == []
    logged = {r.filename: (r.status, r.destination) for r in logs.read_items(spark, f"{root}/log").collect()}
    assert logged == {"a.txt": ("success", "unknown/a.txt"), "b.txt": ("success", "unknown/b.txt")}
    assert cloud.answered(spark, root).count() == 3


def test_a_new_version_of_an_object_is_handled(spark, tmp_path):
    rows = [(*row, "v1") for row in stored(tmp_path, ("a.txt",))]
    versioned = f"{EVENTS}, version string"
    store, root = str(tmp_path / "store"), str(tmp_path / "root")
    twice = spark.createDataFrame(rows + [(9, *rows[0][1:])], versioned)  # one event, delivered twice at once
    assert [r.seq for r in cloud.run_events(spark, twice, store, root).collect()] == [0]
    (tmp_path / "store/intake/0/a.txt").write_bytes(b"a second readable text")
    newer = spark.createDataFrame([(12, *rows[0][1:4], "v2")], versioned)
    assert [(r.seq, r.moved) for r in cloud.run_events(spark, newer, store, root).collect()] == [(12, True)]
    assert (tmp_path / "root/organised/unknown/a.txt").read_bytes() == b"a second readable text"
    assert [r.seq for r in cloud.run_events(spark, twice, store, root).collect()] == [0]
    assert cloud.run_events(spark, newer.limit(0), store, root).count() == 0


def test_the_log_of_items_stays_small(spark, tmp_path):
    path = str(tmp_path / "log")
    expected = {}
    for i in range(30):
        rows = [(f"f{(i * 7 + j) % 11}", 100 * i + j, f"s{i}") for j in range(3)]
        expected |= {name: (seq, status) for name, seq, status in rows}
        logs.put_items(spark.createDataFrame(rows, "filename string, seq long, status string").coalesce(1), path, fan=3)
    runs_left = [n for tier in child_names(spark, path) for n in child_names(spark, f"{path}/{tier}")]
    assert len(runs_left) <= 24  # a tier holds what waits to be merged and what was merged last
    assert {r.filename: (r.seq, r.status) for r in logs.read_items(spark, path).collect()} == expected
    logs.compact_items(spark, path)
    assert len([n for tier in child_names(spark, path) for n in child_names(spark, f"{path}/{tier}")]) == 1
    assert {r.filename: (r.seq, r.status) for r in logs.read_items(spark, path).collect()} == expected
    # A put under the same name replaces itself.
    for _ in range(2):
        logs.put_items(spark.range(2).select(F.lit("x").alias("filename"), F.col("id").alias("seq"), F.lit("y").alias("status")), path, "run=9")
    assert logs.read_items(spark, path).filter("filename = 'x'").count() == 1


def test_recent_opens_the_newest_runs_only(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "root")
    uploads = write(tmp_path / "in", [(f"{i}.mp4", b"%d" % i) for i in range(8)])
    runs.run_folder(spark, uploads, root, local.Settings())
    first = runs.closed_runs(spark, root)[0]
    base = tmp_path / "root/results"
    for i in range(50):
        copy = base / f"run={i:016d}-x"
        copy.mkdir()
        for part in (base / first).iterdir():
            (copy / part.name).write_bytes(part.read_bytes())
    opened = runs.recent(spark, root, 12).inputFiles()
    assert runs.recent(spark, root, 12).count() == 12
    assert len({f.rsplit("/", 2)[1] for f in opened}) == 2
