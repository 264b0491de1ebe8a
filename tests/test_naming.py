"""Clash-free names against a file-by-file model."""

import os
import random

import pytest

from doctriage.operators import naming
from doctriage.operators.naming import assign_names, name_state

POOL = ["a.txt", "a_1.txt", "a_2.txt", "a_1_1.txt", "a_01.txt", "a_1", "a", "b.pdf", "b_3.pdf",
        ".x", ".x_1", "..txt", "._1.txt", "c_1.tar.gz", "c.tar_1.gz", "c.tar.gz"]
SCHEMA = "destination string, file_name string, arrival_seq long"


def place(requests, taken):
    given = {}
    for folder, name, seq in sorted(requests, key=lambda r: r[2]):
        root, ext = os.path.splitext(name)
        number, final = 0, name
        while (folder, final) in taken:
            number += 1
            final = f"{root}_{number}{ext}"
        taken.add((folder, final))
        given[seq] = final
    return given


def random_requests(rng, count, folders=40):
    # Many folders hold many independent small cases in one run.
    return [
        (f"d{rng.randrange(folders)}", rng.choice(POOL), seq)
        for seq in rng.sample(range(10 * count), count)
    ]


def names_of(df):
    return {r.arrival_seq: r.final_name for r in df.collect()}


@pytest.mark.parametrize("max_window_rows", [1_000_000, 5])
def test_matches_sequential_placement(spark, max_window_rows):
    rng = random.Random(7)
    requests = random_requests(rng, 500)
    taken = {(f"d{rng.randrange(40)}", rng.choice(POOL)) for _ in range(60)}
    occupied = spark.createDataFrame(sorted(taken), "destination string, file_name string")
    files = spark.createDataFrame(requests, SCHEMA)
    result = assign_names(files, occupied, max_window_rows=max_window_rows)
    assert names_of(result) == place(requests, set(taken))


def test_state_between_runs_equals_one_run(spark):
    rng = random.Random(11)
    requests = sorted(random_requests(rng, 400, 20), key=lambda r: r[2])
    expected = place(requests, set())
    got, history = {}, None
    for start in range(0, 400, 100):
        files = spark.createDataFrame(requests[start : start + 100], SCHEMA)
        named = assign_names(files, None if history is None else name_state(history))
        rows = named.collect()
        got |= {r.arrival_seq: r.final_name for r in rows}
        done = spark.createDataFrame(rows, named.schema)
        history = done if history is None else history.unionByName(done)
    assert got == expected


def test_simple_clashes_and_unmoved(spark):
    rows = [("d", "a.txt", 1), ("d", "a.txt", 2), ("d", "a_1.txt", 3), (None, "a.txt", 4)]
    got = names_of(assign_names(spark.createDataFrame(rows, SCHEMA)))
    assert got == {1: "a.txt", 2: "a_1.txt", 3: "a_1_1.txt", 4: None}


def test_alternating_names_settle_in_one_pass(spark, monkeypatch):
    """Copies of scan.pdf and scan_1.pdf, scan_2.pdf, ... arriving in turn."""
    rows = [("d", "scan.pdf")]
    for k in range(1, 201):
        rows += [("d", "scan.pdf"), ("d", f"scan_{k}.pdf")]
    passes = []
    staged = naming.stage
    monkeypatch.setattr(naming, "stage", lambda df, name: (passes.append(name), staged(df, name))[1])
    data = [(i, *row) for i, row in enumerate(rows)]
    files = spark.createDataFrame(data, "arrival_seq long, destination string, file_name string")
    got = [r.final_name for r in naming.assign_names(files).orderBy("arrival_seq").collect()]
    taken = set()
    for (_, name), final in zip(rows, got):
        base, number = name[:-4], 0
        while (f"{base}_{number}" if number else base) in taken:
            number += 1
        taken.add(f"{base}_{number}" if number else base)
        assert final == (f"{base}_{number}" if number else base) + ".pdf"
    assert passes.count("children") <= 3
