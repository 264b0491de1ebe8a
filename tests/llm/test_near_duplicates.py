import random

import pytest
from brute import classes, shingles

from doctriage.llm import near_duplicates as nd
from doctriage.llm.components import components

SCHEMA = "doc_id long, text string, id string, kept int, component_id string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA)


def random_text(rng, words):
    return " ".join(f"W{rng.randrange(4000)}" for _ in range(words))


def edited(rng, text, changes):
    words = text.split()
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return rng.choice([" ", "  ", "\t\n"]).join(words)


def clusters(seed):
    """Texts in families whose similarities lie around the threshold, with exact copies."""
    rng = random.Random(seed)
    texts = []
    for _ in range(12):
        base = random_text(rng, 120)
        texts += [edited(rng, base, rng.randrange(0, 11)) for _ in range(12)]
    texts += [random_text(rng, rng.randrange(1, 5)) for _ in range(20)]
    texts += rng.choices(texts, k=40) + ["", " \t", None, "a", "A", "a b", "é b"]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("width", [2, 5])
def test_same_classes_as_all_pairs(spark, width):
    rows = clusters(width)
    found = nd.near_duplicates(table(spark, rows).repartition(4), nd.Likeness(words=width)).collect()
    assert {r.doc_id: r.component_id for r in found} == classes(rows, width)
    assert {r.doc_id: r.n_shingles for r in found} == {i: len(shingles(t, width)) for i, t in rows}
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = nd.near_duplicates(docs, nd.Likeness(words=2)).collect()
    assert {r.doc_id: r.component_id for r in found} == classes(rows, 2)


def test_blocks_of_mixed_buckets(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK_MEMBERS", 3)
    rows = clusters(9)
    found = nd.near_duplicates(table(spark, rows), nd.Likeness(words=2)).collect()
    assert {r.doc_id: r.component_id for r in found} == classes(rows, 2)


def test_null_and_repeated_ids(spark):
    text = "one two three four five six"
    rows = [(None, text), (3, text), (3, text), (3, "other words here"), (5, text), (None, None), (7, None)]
    found = nd.near_duplicates(table(spark, rows)).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in found) == [
        (-1, -1, True), (-1, -1, True), (3, 3, True), (3, 3, True), (3, 3, True), (5, 3, False), (7, 7, True),
    ]
    kept = nd.keep_one(table(spark, rows))
    assert kept.columns == ["doc_id", "text", "id", "kept", "component_id"]
    assert sorted((r.doc_id or -1, r.text or "") for r in kept.collect()) == [
        (-1, ""), (-1, text), (3, text), (3, "other words here"), (7, ""),
    ]


def test_versions_of_an_id_join_their_texts(spark):
    a, b = "one two three four five six", "quite other words than those before"
    rows = [(2, a), (5, a), (5, b), (9, b), (9, None), (11, b), (11, "third text of words that stand alone")]
    found = nd.near_duplicates(table(spark, rows)).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in found} == {(2, 2, True), (5, 2, False), (9, 2, False), (11, 2, False)}
    kept = sorted((r.doc_id, r.text or "") for r in nd.keep_one(table(spark, rows)).collect())
    assert kept == [(2, a), (5, b), (9, ""), (11, "third text of words that stand alone")]


def test_random_versions_as_all_pairs(spark):
    rng = random.Random(12)
    rows = [(i if rng.random() < 0.8 else rng.randrange(40), t) for i, t in clusters(7)]
    rows += rows[:9]
    found = nd.near_duplicates(table(spark, rows), nd.Likeness(words=2)).collect()
    expected = classes(rows, 2)
    assert all(r.component_id == expected[r.doc_id] for r in found) and len(found) == len(rows)
    # Every text that goes is near to one that stays; no two that stay are near to each other.
    kept = [(r.doc_id, r.text) for r in nd.keep_one(table(spark, rows), nd.Likeness(words=2)).collect()]
    numbered = classes(list(enumerate(t for _, t in rows)), 2)
    groups = {}
    for at, (_, text) in enumerate(rows):
        groups.setdefault(numbered[at], set()).add(text)
    staying = [text for _, text in kept if shingles(text, 2)]
    assert sorted(min(g & set(staying)) for g in groups.values() if shingles(min(g, key=str), 2)) == sorted(staying)


def test_empty_and_long(spark):
    assert nd.near_duplicates(table(spark, [])).count() == 0
    long = random_text(random.Random(1), 60_000)
    rows = [(1, long), (2, long + " end"), (3, "q" * 1_000_000)]
    found = nd.near_duplicates(table(spark, rows)).collect()
    assert {r.doc_id: r.component_id for r in found} == {1: 1, 2: 1, 3: 3}


def test_components_of_paths_and_stars(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)]
    edges += [(200, 200), (None, 4), (205, 201), (201, 205)]
    rng.shuffle(edges)
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    expected = {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)} | {201: 201, 205: 201}
    assert {r.node: r.component for r in found} == expected
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
