import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from doctriage.llm import grams, language, quality

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, score string, label int, id int, n int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, x, "s", "c", 1, 2, 3) for i, t, x in rows], SCHEMA)


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_n_grams_against_plain_counting():
    points = np.array([ord(c) for c in "abcabc a"], np.uint32)
    counts = grams.count_grams(points, 3, 1 << 15)
    text = "abcabc a"
    plain = [text[i : i + n] for n in (1, 2, 3) for i in range(len(text) - n + 1)]
    assert counts.sum() == len(plain)
    assert sorted(counts[counts > 0]) == sorted(plain.count(g) for g in set(plain))


def test_document_frequencies(spark):
    texts = ["ab", "a b", "", None, "ab", "ÀÉ"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    found, total = grams.document_frequencies(df, language.letter_grams, language.BUCKETS)
    expected = sum((language.letter_grams(t or "") > 0).astype(int) for t in texts)
    assert total == len(texts) and (found == expected).all()


def test_leader_regression_is_sparse_and_separates():
    rng = np.random.default_rng(0)
    rows = []
    for i in range(300):
        label = i % 3
        terms = np.unique(np.append(rng.integers(10, 500, 8), label))
        rows.append((terms, np.full(len(terms), 1 / math.sqrt(len(terms)), np.float32), label))
    weights, bias = language.fit_leader(rows, 500, 3, language.Training(l1=0.5))
    right = [int((x @ weights[t] + bias).argmax()) == y for t, x, y in rows]
    assert np.mean(right) > 0.97 and (weights == 0).mean() > 0.3


def test_temperature_undoes_scaling():
    rng = np.random.default_rng(1)
    scores = rng.normal(size=(4000, 3))
    labels = np.array([rng.choice(3, p=language.softmax(s)) for s in scores])
    assert abs(language.fit_temperature(scores * 4, labels) - 4) < 0.6


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    apart = [r.lang == r.lang_pred for r in rows if r.held_out]
    assert len(apart) > 100 and np.mean(apart) > 0.97


def test_language_edge_rows(spark):
    rows = [(i, "un deux trois quatre " * 3, "fr") for i in range(30)]
    rows += [(100 + i, "one two three four " * 3, "en") for i in range(30)]
    rows += [(200, None, "fr"), (201, "", None), (202, "12 -- 3", "en"), (None, "deux trois", "fr")]
    rows += [(203, "three two one", None), (203, "three two one", None), (204, "deux " * 400_000, "zz")]
    found = language.identify(table(spark, rows)).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found}
    for i in (200, 201, 202):
        assert (by_id[i].lang_pred, by_id[i].score) == ("und", 0.0)
    assert by_id[None].lang_pred == "fr" and not by_id[None].held_out
    assert [r.lang_pred for r in found if r.doc_id == 203] == ["en", "en"]
    # Neither the held-out documents nor the own label are inputs.
    assert held(204) or by_id[204].lang_pred in ("fr", "zz")
    kept = language.keep_identified(table(spark, rows))
    assert kept.columns == table(spark, rows).columns
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {200, 201, 202}


def test_language_without_anything_to_learn(spark):
    assert language.identify(table(spark, [])).count() == 0
    only = table(spark, [(1, "some words", None), (2, None, "en")])
    assert {r.lang_pred for r in language.identify(only).collect()} == {"und"}


def test_quality_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = quality.score(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == (r.score >= 0.3) for r in rows)
    good = [r.score for r in rows if r.held_out and r.quality == 1]
    bad = [r.score for r in rows if r.held_out and r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert min(good) >= 0.3


def test_votes_against_all_cosines(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = quality.learn(docs, labels, quality.Voting(neighbours=7))
    found = {r.doc_id: r.score for r in quality.score(docs, labels, quality.Voting(neighbours=7)).collect()}
    for row in docs.limit(40).collect():
        own = model.place([row.text])[0].astype(float)
        near = sorted(((float(own @ v), y) for v, y in zip(model.vectors, model.labels)), reverse=True)[:7]
        total = sum(max(s, 0) for s, _ in near)
        assert found[row.doc_id] == pytest.approx(sum(max(s, 0) * y for s, y in near) / total, abs=1e-4)


def test_quality_edge_rows(spark):
    rows = [(i, "Words of a plain text, then more. " * (i % 7 + 1), "en") for i in range(40)]
    rows += [(100 + i, "### $$$ %%% " * (i % 7 + 1), "en") for i in range(40)]
    rows += [(200, None, "x"), (201, "", "x"), (None, "### $$$", "x"), (203, "a" * 1_500_000, "x")]
    labels = [(i, 1, 0) for i in range(40)] + [(100 + i, 0, 0) for i in range(40)]
    labels += [(1, 1, 1), (None, 1, 0), (3, None, 0), (999, 1, 0)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in quality.score(table(spark, rows), marks).collect()}
    assert len(found) == len(rows)
    assert found[200].score == found[201].score > 0.3
    assert found[None].predicted == 0 and not found[None].held_out
    assert quality.score(table(spark, []), marks).count() == 0
    none = quality.score(table(spark, rows), marks.filter("doc_id < 0")).collect()
    assert {r.score for r in none} == {0.5}


def test_only_learned_languages_are_kept(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang")
    given = [r.text for r in docs.filter("doc_id < 40").orderBy("doc_id").collect()]
    short = [" ".join(t.split()[3:7]) for t in given if len(t.split()) > 10]
    other = [
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw",
        "Все люди рождаются свободными и равными в своем достоинстве и правах",
        "人人生而自由在尊严和权利上一律平等",
        "xqzv wkjq pfgh zzxk qwrt vbnm lkjh gfds xcvb qzqz",
    ]
    added = [(10**9 + i, t, None) for i, t in enumerate(short)] + [(2 * 10**9 + i, t, None) for i, t in enumerate(other)]
    rows = docs.unionByName(spark.createDataFrame(added, "doc_id long, text string, lang string"))
    kept = {r.doc_id for r in language.keep_identified(rows).select("doc_id").collect()}
    assert len(short) > 20
    assert kept == {r.doc_id for r in rows.filter("doc_id < 2000000000").collect()}


def test_repeated_ids_are_sampled_once(spark):
    rows = [(i, f"un deux {'trois ' * i}", "fr") for i in range(10)]
    rows += [(100, f"one two {'three ' * (i % 7)}", "en") for i in range(300)] + [(100, "un deux", "fr")]
    usable = table(spark, rows).repartition(4).select("doc_id", "text", "lang")
    ids = spark.createDataFrame([(100, "en", 1), (100, "fr", 1), (3, "fr", 2)], "id long, label string, draw long")
    found = language.drawn_texts(usable, ids).collect()
    assert sorted((r.id, r.label, r.draw) for r in found) == [(3, "fr", 2), (100, "en", 1), (100, "fr", 1)]
    assert {(r.id, r.text, r.label) for r in found} <= set(rows)


def test_chunks_count_like_the_whole_text(monkeypatch):
    texts = ["The quick, brown fox -- jumps! 12 times Über   die Mauer. " * 3, "a", "", "--", "ab 1 cd", "x" * 20]
    whole = [(language.letter_grams(t), quality.look(t)) for t in texts]
    for size in (1, 2, 7):
        monkeypatch.setattr(grams, "CHUNK", size)
        for text, (letters, looks) in zip(texts, whole):
            assert (language.letter_grams(text) == letters).all() and (quality.look(text) == looks).all()


def test_scores_do_not_depend_on_the_order_of_versions(spark):
    rows = [(i, f"Words of text {j} here. " * (i % 5 + j), "en") for i in range(40) for j in (1, 3)]
    rows += [(100 + i, "## $$ " * (i % 5 + j), "x") for i in range(40) for j in (1, 2)]
    marks = [(i, 1, 0) for i in range(40)] + [(100 + i, 0, 0) for i in range(40)] + [(900 + i, 0, 0) for i in range(50)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    runs = [
        sorted(map(tuple, quality.score(table(spark, own).repartition(n), labels).collect()), key=str)
        for own, n in ((rows, 2), (rows[::-1], 7))
    ]
    assert runs[0] == runs[1]
