"""Runs with state under a root folder, and the command line."""

import hashlib
import time

from test_triage import GOOD, FixedModel, by_name, write

from doctriage.__main__ import main
from doctriage.operators import model
from doctriage.plans import local, runs
from doctriage.queries import QUERIES
from doctriage.session import job_stages, path_exists, stage
from doctriage.sinks.files import copy_files
from doctriage.sources import files as files_source
from doctriage.sources.files import dealt, fetch, list_folder, read_fingerprints


def test_later_run_knows_contents_and_names(spark, tmp_path):
    settings = local.Settings(model=FixedModel())
    root = str(tmp_path / "root")
    assert runs.log(spark, root).first().entry == "no logs yet"
    first = write(tmp_path / "one", [("a.txt", GOOD), ("b.txt", b"")])
    second = write(tmp_path / "two", [("a.txt", b"another readable text"), ("copy.txt", GOOD), ("b.txt", b"")])
    assert by_name(runs.run_folder(spark, first, root, settings))["a.txt"].status == "success"
    got = by_name(runs.run_folder(spark, second, root, settings))
    assert (got["copy.txt"].outcome, got["a.txt"].final_name) == ("duplicate", "a_1.txt")
    assert (tmp_path / "root/documents/legal/contracts/a_1.txt").read_bytes() == b"another readable text"
    assert sorted(p.name for p in (tmp_path / "root/documents/miscellaneous/unreadable").iterdir()) == ["b.txt", "b_1.txt"]
    counters, totals = runs.summary(spark, root)
    assert (counters.first().contracts, counters.first().duplicates, counters.first().failed) == (2, 1, 2)
    assert tuple(totals.first()) == (5, 2, 3)
    assert runs.log(spark, root).count() == 5


def test_command_line(spark, tmp_path, capsys):
    words = {"resumes": "python engineer degree", "invoices": "amount due bill", "paystubs": "salary gross net",
             "contracts": "party agreement clause"}
    folder = tmp_path / "samples"
    folder.mkdir()
    for name, text in words.items():
        lines = [f"{text} {text} sample number {i}" for i in range(12)]
        (folder / f"{name}.txt").write_text("\n".join(lines), encoding="utf-8")
    main(["train", str(folder), str(tmp_path / "model")])
    assert "accuracy:" in capsys.readouterr().out
    assert model.load(spark, str(tmp_path / "model")).labels == ["Contract", "Invoice", "Paystub", "Resume"]
    uploads = write(tmp_path / "in", [("a.txt", b"salary gross net salary gross net pay")])
    main(["triage", uploads, str(tmp_path / "root"), "--model", str(tmp_path / "model")])
    main(["watch", uploads, str(tmp_path / "root"), "--model", str(tmp_path / "model"), "--once"])
    main(["summary", str(tmp_path / "root")])
    main(["log", str(tmp_path / "root")])
    results = runs.results(spark, str(tmp_path / "root")).collect()
    assert [r.status for r in results] == ["success"]


def test_names_that_need_care_and_a_foreign_file(spark, tmp_path):
    settings = local.Settings(model=FixedModel())
    root = tmp_path / "my documents" / "root"
    place = root / "documents/miscellaneous/unsupported"
    place.mkdir(parents=True)
    (place / "v.mp4").write_bytes(b"someone else's")
    names = ["a b.mp4", "c%20d.mp4", "e#f.mp4", "ü.mp4", "v.mp4", ".hidden", "_x.mp4"]
    uploads = write(tmp_path / "in put", [(n, n.encode()) for n in names])
    got = by_name(runs.run_folder(spark, uploads, str(root), settings))
    assert (place / "v.mp4").read_bytes() == b"someone else's"
    assert got["v.mp4"].final_name == "v_1.mp4"
    assert {p.name: p.read_bytes() for p in place.iterdir() if p.name != "v.mp4"} == {
        ("v_1.mp4" if n == "v.mp4" else n): n.encode() for n in names
    }
    again = runs.run_folder(spark, uploads, str(root), settings)
    assert again.count() == 0 and len(list(place.iterdir())) == len(names) + 1


def test_copying_never_replaces(spark, tmp_path):
    source, sink = tmp_path / "s", tmp_path / "t" / "documents"
    source.mkdir(), sink.mkdir(parents=True)
    for name in ("same", "other", "new"):
        (source / name).write_bytes(b"x" * 10)
    (sink / "same").write_bytes(b"x" * 10)
    (sink / "other").write_bytes(b"y" * 10)
    rows = [(f"file:{source}/{n}", "documents", n) for n in ("same", "other", "new", "missing")]
    plan = spark.createDataFrame(rows, "path string, destination string, final_name string")
    done = {r.final_name: r.copied for r in copy_files(plan, str(tmp_path / "t")).collect()}
    assert done == {"same": True, "other": False, "new": True, "missing": False}
    assert (sink / "other").read_bytes() == b"y" * 10 and (sink / "new").exists()


def test_newest_first_and_log_in_order_over_runs(spark, tmp_path):
    settings = local.Settings(model=FixedModel())
    root = str(tmp_path / "root")
    uploads = write(tmp_path / "in", [(f"old{i}.mp4", b"x%d" % i) for i in range(3)])
    runs.run_folder(spark, uploads, root, settings)
    write(tmp_path / "in", [("new.mp4", b"later")])
    runs.run_folder(spark, uploads, root, settings)
    assert [r.file_name for r in runs.recent(spark, root).collect()][0] == "new.mp4"
    assert "new.mp4" in runs.log(spark, root).collect()[-1].entry
    left = tmp_path / "root/results"
    assert len(list(left.glob("run=*"))) == 2


def test_watcher_does_the_whole_job(spark, tmp_path):
    root = tmp_path / "root"
    uploads = write(tmp_path / "in", [("a.mp4", b"x"), ("empty.txt", b""), (".hidden", b"y")])
    query = runs.watch(spark, uploads, str(root), local.Settings(), every="1 second")
    try:
        until = time.time() + 120
        while time.time() < until and runs.results(spark, str(root)).count() < 3:
            time.sleep(1)
        write(tmp_path / "in", [("b.mp4", b"z")])
        while time.time() < until and runs.results(spark, str(root)).count() < 4:
            time.sleep(1)
    finally:
        query.stop()
    got = by_name(runs.results(spark, str(root)))
    assert {n: r.status for n, r in got.items()} == {
        "a.mp4": "unsupported", "b.mp4": "unsupported", "empty.txt": "rejected", ".hidden": "unsupported"
    }
    assert (root / "documents/miscellaneous/unsupported/b.mp4").read_bytes() == b"z"
    assert runs.summary(spark, str(root))[1].first().total == 4
    assert [r.file_name for r in runs.recent(spark, str(root)).collect()][0] == "b.mp4"


def test_large_file_is_fingerprinted_and_jobs_leave_no_stages(spark, tmp_path):
    write(tmp_path / "in", [("big.txt", b"x" * 5000), ("small.txt", b"y")])
    listed = list_folder(spark, str(tmp_path / "in"))
    got = {r.path.rsplit("/", 1)[1]: r for r in fetch(listed, content_bytes=1000).collect()}
    assert got["big.txt"].content is None and got["big.txt"].length == 5000
    assert got["big.txt"].md5 == hashlib.md5(b"x" * 5000).hexdigest()
    with job_stages(spark):
        path = stage(spark.range(3), "kept")._staged_at
        assert path_exists(spark, path)
    assert not path_exists(spark, path)


def test_work_on_files_is_dealt_out_by_files(spark, tmp_path, monkeypatch):
    contents = {f"{i}.bin": bytes([i]) * i for i in range(24)}
    uploads = write(tmp_path / "in", list(contents.items()))
    listed = stage(list_folder(spark, uploads).coalesce(1), "one-part")
    cores = spark.sparkContext.defaultParallelism
    # A narrow listing is one partition; the work behind it is not.
    assert listed.rdd.getNumPartitions() == 1
    assert dealt(listed).rdd.getNumPartitions() == cores
    assert dealt(listed.limit(3)).rdd.getNumPartitions() == 3
    prints = read_fingerprints(listed)
    assert prints.rdd.getNumPartitions() == cores
    got = {r.path.rsplit("/", 1)[1]: r.md5 for r in prints.collect()}
    assert got == {name: hashlib.md5(content).hexdigest() for name, content in contents.items()}
    monkeypatch.setattr(files_source, "TASK_FILES", 2)
    assert dealt(listed).rdd.getNumPartitions() == cores * -(-12 // cores)
    monkeypatch.setattr(files_source, "TASK_BYTES", 4)
    assert dealt(listed).rdd.getNumPartitions() == len(contents)
    assert dealt(listed.select("path")).rdd.getNumPartitions() == cores * -(-12 // cores)


def test_copies_are_dealt_out_and_tasks_have_folders_of_their_own(spark, tmp_path):
    names = [f"{i}.bin" for i in range(24)]
    uploads = write(tmp_path / "in", [(name, name.encode()) for name in names])
    rows = [(f"file:{uploads}/{name}", "documents", name) for name in names]
    plan = stage(spark.createDataFrame(rows, "path string, destination string, final_name string").coalesce(1), "plan")
    copies = copy_files(plan, str(tmp_path / "root"), str(tmp_path / "parts"))
    tasks = copies.rdd.getNumPartitions()
    assert tasks == spark.sparkContext.defaultParallelism
    assert {(r.final_name, r.copied) for r in copies.collect()} == {(name, True) for name in names}
    assert {p.name: p.read_bytes() for p in (tmp_path / "root/documents").iterdir()} == {n: n.encode() for n in names}
    spare = list((tmp_path / "parts").iterdir())
    assert 1 < len(spare) <= tasks and not any(list(own.iterdir()) for own in spare)


def test_contents_of_several_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files_source, "PIECE_BYTES", 7)
    contents = {f"{size}.bin": bytes(range(size)) for size in (0, 1, 6, 7, 8, 14, 20, 21, 22, 60)}
    listed = list_folder(spark, write(tmp_path / "in", list(contents.items())))
    for most in (0, 20, 21, 1000):
        got = {r.path.rsplit("/", 1)[1]: r for r in fetch(listed, content_bytes=most).collect()}
        assert got.keys() == contents.keys()
        for name, content in contents.items():
            row = got[name]
            assert (row.length, row.md5) == (len(content), hashlib.md5(content).hexdigest())
            assert row.content is None if len(content) > most else bytes(row.content) == content


def test_the_watched_folder_ends_where_documents_repeat(spark, tmp_path):
    rows = [(i, "some readable text %d" % i) for i in (*range(1, 9), 1, 2, 2, 7)]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    # Some files that are written twice would count for those that are still to come.
    made.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["watched_folder"](spark, str(tmp_path)).collect()
    assert len({r.file_name for r in got}) == 8
    assert {r.outcome for r in got} <= {"unsupported", "unreadable", "error"}
