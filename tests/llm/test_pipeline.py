"""The chain of stages against plain versions of each, on what its predecessor wrote."""

from collections import Counter
from pathlib import Path

import brute
import duckdb
import pyarrow.parquet as pq
from pyspark.sql import functions as F
from test_personal_data import redacted
from test_templates import brute_whole

import corpus_pipeline
from doctriage.llm import grams, language
from doctriage.llm.queries import SQL
from doctriage.session import shared_folder

GIVEN = Path("/root/testdata/sf0.001")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ITEMS = "item_id long, text string"
NAMES = DOCS.replace(" long", "").replace(" string", "").split(", ")


def given():
    rows = pq.read_table(GIVEN / "documents.parquet").select(NAMES).to_pylist()
    return [tuple(r.values()) for r in rows if r["text"] and 60 < len(r["text"].split()) < 150 and r["lang"] and r["source"]]


def short_items(count):
    rows = pq.read_table(GIVEN / "benchmark.parquet").to_pylist()
    return [(r["item_id"], r["text"]) for r in rows if 12 < len(r["text"].split()) < 40][:count]


def written(spark, folder, rows, items, **more):
    docs = spark.createDataFrame(rows, DOCS).withColumns({name: F.lit(value) for name, value in more.items()})
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, ITEMS).write.parquet(f"{folder}/benchmark.parquet")


def outputs(spark, folder):
    """What each stage of a run wrote."""
    shared = Path(shared_folder(spark).removeprefix("file:"))
    before = set(shared.glob("pipeline-*"))
    corpus_pipeline.run(spark, str(folder))
    (run,) = set(shared.glob("pipeline-*")) - before
    return [spark.read.parquet(f"{run}/{at}") for at in range(len(corpus_pipeline.STAGES))]


def rows_of(df):
    return [tuple(r[name] for name in NAMES) for r in df.collect()]


def identified(spark, rows):
    docs = spark.createDataFrame(rows, DOCS)
    model = language.learn(docs.filter(grams.fold(F.col("doc_id")) != 0))
    found = []
    for row in rows:
        if row[1] and any(c.isalpha() for c in row[1]):
            _, score, known = model.judge(row[1])
            found += [row] if score >= 0.25 and known >= 0.5 else []
    return found


def deduplicated(rows):
    """Texts in order of their ids: the first of each class of near texts."""
    order = sorted(set(rows), key=str)
    order.sort(key=lambda r: r[0])
    first = brute.classes([(at, r[1]) for at, r in enumerate(order)], 5)
    return [r for at, r in enumerate(order) if first[at] == at]


def test_each_stage_as_its_plain_version(spark, tmp_path):
    base, items = given()[:40], short_items(5)
    one, two, three = base[0], base[1], base[2]
    words = three[1].split()
    near = " ".join([*words[:5], "changed", *words[6:]])
    planted = [
        (9001, None, None, None, 0), (9002, "", "en", "src-1", 0), (9003, "!!! 12 ??", "en", "src-1", 9),
        (one[0], f"{base[-1][1]} and {base[-2][1]}", *one[2:]),  # an id with another text
        two,  # a row that repeats
        (9005, two[1], *two[2:]), (9006, near, *three[2:]),
        (9007, f"{base[4][1]} {base[5][1]} {items[0][1]}", *base[4][2:]),
        (9008, f"{base[6][1]} {base[7][1]} write to a.b@pay.example now", *base[6][2:]),
    ]
    rows = [*base, *planted]
    written(spark, tmp_path, rows, items)
    stages = outputs(spark, tmp_path)
    found = [rows_of(df) for df in stages]

    assert Counter(found[0]) == Counter(identified(spark, rows))
    assert not {9001, 9002, 9003} & {r[0] for r in found[0]} and len(found[0]) >= len(base)
    assert Counter(found[1]) == Counter(deduplicated(found[0]))
    assert not {9005, 9006} & {r[0] for r in found[1]} and sum(r[0] == one[0] for r in found[1]) == 2
    # Ids repeat, so the plain version is asked by the place of a row.
    leaked = {at for at, _ in brute_whole([(at, r[1]) for at, r in enumerate(found[1])], items, corpus_pipeline.templates.WHOLE)}
    assert Counter(found[2]) == Counter(r for at, r in enumerate(found[1]) if at not in leaked)
    assert 9007 not in {r[0] for r in found[2]}
    plain = [(i, redacted(text), *rest, len(redacted(text))) for i, text, *rest, _ in found[2]]
    assert Counter(found[3]) == Counter(plain)
    assert any(i == 9008 and "a.b@" not in text for i, text, *_ in found[3])
    con = duckdb.connect()
    con.register("documents", stages[3].toArrow())
    chosen = con.execute(f"SELECT doc_id, epoch, n_tokens FROM ({SQL['op10_mixture']})").fetchall()
    mixed = [(r.doc_id, r.epoch, len(brute.WORD.findall(r.text))) for r in stages[4].collect()]
    assert Counter(mixed) == Counter(chosen) and mixed


def test_nulls_repeats_and_other_columns(spark, tmp_path):
    base, items = given()[:12], [*short_items(2), (None, "no id"), (7, None), (8, "")]
    rows = [*base, *base[:2], (None, base[3][1], None, None, None), (None, None, None, None, None)]
    rows += [(base[0][0], None, "en", "src-1", None), (base[0][0], base[5][1], None, None, 1), (9001, "ab " * 50_000, "en", None, 1)]
    more = {"epoch": 1, "key": "k", "domain": "d", "component": 1, "lang_pred": "x", "score": 0.5, "_row": "r", "fingerprint": "f"}
    written(spark, tmp_path, rows, items, **more)
    stages = outputs(spark, tmp_path)
    for df in stages:
        assert {*NAMES, *more} <= set(df.columns) and df.count() > 0
        assert len(df.columns) == len(NAMES) + len(more)
    assert all(r.text for r in stages[0].collect())


def test_empty_tables(spark, tmp_path):
    written(spark, tmp_path, [], [])
    stages = outputs(spark, tmp_path)
    assert [df.count() for df in stages] == [0] * 5 and {*NAMES, "epoch"} == set(stages[4].columns)
