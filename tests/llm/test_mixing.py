import hashlib

from pyspark.sql import functions as F

import corpus_pipeline
from doctriage.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, epoch string, domain int, key string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, x, s, 1, "e", 2, "k") for i, t, x, s in rows], SCHEMA)


def targets(epochs=2):
    one = F.lit(1)
    return mixing.Targets(F.substring("source", 1, 1), (one, one, one), epochs=epochs)


def test_shortages_stay_among_siblings(spark):
    rows = [(i, "w " * 10, "en", "a1") for i in range(2)]  # 20 tokens, 40 in two epochs
    rows += [(100 + i, "w " * 10, "en", "a2") for i in range(30)]
    rows += [(200 + i, "w " * 10, "en", "b1") for i in range(30)]
    found = mixing.choose(table(spark, rows), targets(), (1, 2)).collect()
    given = {}
    for r in found:
        given[r.source] = given.get(r.source, 0) + r.n_tokens
    # 310 tokens: 155 for each domain; a1 holds 40 of its 77, its sibling takes what it lacks.
    assert given == {"a1": 40, "a2": 120, "b1": 160}
    assert sorted(r.epoch for r in found if r.source == "a1") == [0, 0, 1, 1]
    queue = sorted(range(100, 130), key=lambda i: hashlib.md5(f"17:0:{i}".encode()).hexdigest())
    assert sorted(r.doc_id for r in found if r.source == "a2") == sorted(queue[:12])


def test_narrowing_gives_the_same_prefix(spark, monkeypatch):
    rows = [(i, "w " * (i % 7), "en", "a1") for i in range(400)]
    whole = {r.doc_id for r in mixing.choose(table(spark, rows), targets(), (1, 3)).collect()}
    monkeypatch.setattr(mixing, "BOUNDARY_ROWS", 1)
    assert {r.doc_id for r in mixing.choose(table(spark, rows), targets(), (1, 3)).collect()} == whole


def test_edge_rows(spark):
    rows = [(None, "a b", None, None), (1, None, "en", "a1"), (2, "", "en", "a1"), (3, "x y z", "en", "a1")]
    rows += [(3, "x y z", "en", "a1"), (4, "w " * 200_000, "en", "b1")]
    mixed = mixing.mix(table(spark, rows), targets(), (1, 1))
    assert sorted(mixed.columns) == sorted(table(spark, rows).columns)
    assert {r.doc_id for r in mixed.collect()} >= {None, 3, 4}
    assert mixing.mix(table(spark, []), targets(), (1, 1)).count() == 0


def test_stages(spark):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and set(docs.columns) < set(out.columns)


def test_repeated_ids_stay_within_the_budget(spark):
    rows = [(7, f"w{i % 3} " * (5 + i % 2), "en", "a1") for i in range(200)]
    rows += [(1000 + i, "w " * 6, "en", "a1") for i in range(200)]
    chosen = mixing.choose(table(spark, rows), targets(1), (1, 2))
    mixed = mixing.mix(table(spark, rows), targets(1), (1, 2)).collect()
    tokens = [r.n_tokens for r in chosen.collect()]
    assert sorted(len(r.text.split()) for r in mixed) == sorted(tokens)
    assert sum(tokens) < 1150 + 6
    again = mixing.mix(table(spark, rows[::-1]).repartition(5), targets(1), (1, 2)).collect()
    assert sorted(again, key=str) == sorted(mixed, key=str)


def test_rows_of_one_id_in_several_leaves(spark):
    rows = [(1, "w " * 10, "en", s) for s in ("a1", "a2", "b1")] + [(None, "w " * 10, None, "a1")] * 3
    chosen = mixing.choose(table(spark, rows), targets(), (3, 2)).collect()
    mixed = mixing.mix(table(spark, rows), targets(), (3, 2)).collect()
    assert sorted((r.epoch, r.source, r.n_tokens) for r in chosen) == sorted(
        (r.epoch, r.source, len(r.text.split())) for r in mixed
    )
