"""Vocabulary pruning, the fitted classifier, persistence and guards."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from doctriage.operators import features, model
from doctriage.operators.evaluation import class_report
from doctriage.plans import training
from doctriage.plans.local import Settings, content_facts
from doctriage.sources.samples import read_samples

TOPICS = {
    "Resume": "experience engineer skills university degree python project team".split(),
    "Invoice": "invoice amount due payment total bill number tax".split(),
    "Paystub": "salary gross net deduction employee pay period hours".split(),
    "Contract": "agreement party terms clause law signature obligation term".split(),
}


def samples(spark, per_label=30, seed=1):
    rng = random.Random(seed)
    shared = "the and of document page date name city".split()
    rows = [
        (" ".join(rng.choice(words if rng.random() < 0.6 else shared) for _ in range(25)), label)
        for label, words in TOPICS.items()
        for _ in range(per_label)
    ]
    return spark.createDataFrame(rows, "text string, label string")


@pytest.mark.parametrize("pruning_words", [20_000, 0])
def test_pruned_vocabulary_is_exact(spark, pruning_words):
    rows = [r.text for r in samples(spark).collect()]
    counts = Counter()
    for text in rows:
        words = [w for w in text.split() if w not in ("the", "and", "of")]
        for n in (1, 2, 3):
            counts.update(" ".join(words[i : i + n]) for i in range(len(words) - n + 1))
    expected = sorted(counts.items(), key=lambda c: (-c[1], c[0]))[:20]
    df = spark.createDataFrame([(t,) for t in rows], "text string")
    words = features.with_words(df, ["the", "and", "of"])
    got = features.term_counts(words, 20, pruning_words=pruning_words).collect()
    assert [tuple(r) for r in got] == expected


def test_terms_are_counted_like_the_count_vectorizer(spark):
    texts = ["b a b a c", "", None, "a", "c c c c", "b\u00e9 zz a_1 b\u00e9 zz a_1 b\u00e9", "Aa bb! Aa; bb cc", "cc Aa"]
    docs = spark.createDataFrame(list(enumerate(texts * 3)), "words long, text string").repartition(2)
    fitted = features.fit_vectorizer(docs, ["bb"], 9)
    assert 0 < len(fitted.vocabulary) <= 9 and "b\u00e9 zz" in fitted.vocabulary
    counted = features.with_counts(docs, fitted.stages)
    got = {r.words: (r.term_ids, r.term_counts) for r in counted.collect()}
    terms = fitted.stages.transform(docs.select(F.col("words").alias("id"), "text"))
    own = {r.id: (r.counts.indices.tolist(), r.counts.values.tolist()) for r in terms.select("id", "counts").collect()}
    assert got == own
    assert fitted.idf == pytest.approx(features.fit_idf(counted, len(fitted.vocabulary)))


def test_document_frequencies_come_with_the_counts(spark):
    """One pass over the words gives both; documents of one batch and of several partitions."""
    rows = [(["aa", "bb", "aa", "bb"],), (["bb", "aa"],), ([],), (["aa", "cc", "bb"],)] * 50
    words = spark.createDataFrame(rows, "words array<string>").repartition(3)
    got = {r.term: (r.n, r.df) for r in features._terms(words, 3).collect()}
    assert got == {"aa": (200, 150), "bb": (200, 150), "bb aa": (100, 100)} or got == {
        "aa": (200, 150), "bb": (200, 150), "aa bb": (100, 50)
    }


def test_scoring_carries_no_contents(spark):
    """What no later step needs is not handed past the scoring."""
    fitted = model.fit(samples(spark), stop_words=[])
    files = spark.createDataFrame(
        [("f.txt", ".txt", "text of a file", "content of a file")], "file_name string, file_ext string, text string, content string"
    )
    facts = content_facts(files, Settings(model=fitted))
    assert set(facts.columns) == {"file_name", "file_ext", "readable", "prompt", "ml_label", "ml_confidence"}
    plan = facts._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("ArrowEvalPython")]
    assert "content" not in above and "_scored" not in above and "struct" not in above


def test_solution_has_no_gradient(spark):
    """At the optimum of mean loss + |w|^2 / (2 C n) all derivatives vanish."""
    train = samples(spark)
    fitted = model.fit(train, stop_words=["the"], tolerance=1e-10)
    vocabulary = fitted.vectorizer.stages[-1].vocabulary
    vectorizer = features.Vectorizer(fitted.vectorizer, None, vocabulary, fitted.idf)
    numbered = train.withColumn("doc_id", F.monotonically_increasing_id())
    rows = features.tfidf_of(vectorizer, numbered.select("doc_id", "text")).collect()
    ids = {term: i for i, term in enumerate(vocabulary)}
    labels = {r.doc_id: r.label for r in numbered.collect()}
    docs = {doc: i for i, doc in enumerate(sorted(labels))}
    x = np.zeros((len(docs), len(ids)))
    for r in rows:
        x[docs[r.doc_id], ids[r.term]] = r.weight
    y = np.array([[labels[d] == name for name in fitted.labels] for d in sorted(labels)], float)
    w, b = np.array(fitted.coefficients), np.array(fitted.intercepts)
    z = x @ w.T + b
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    gradient = (p - y).T @ x / len(docs) + w / (5.0 * len(docs))
    assert np.abs(gradient).max() < 1e-6 and np.abs((p - y).mean(0)).max() < 1e-6


def test_train_save_load(spark, tmp_path):
    path = str(tmp_path / "model")
    result = training.train(samples(spark), path)
    assert result.accuracy > 0.9
    loaded = model.load(spark, path)
    examples = spark.createDataFrame(
        [(" ".join(words), label) for label, words in TOPICS.items()], "text string, expected string"
    )
    assert tuple(training.smoke_check(loaded, examples).first()) == (True, 4, 4)
    mine = result.model.score(examples).orderBy("text").collect()
    theirs = loaded.score(examples).orderBy("text").collect()
    assert mine == theirs
    for row in mine:
        assert sum(row.probabilities) == pytest.approx(1.0)
    assert model.load(spark, str(tmp_path / "absent")) is None


def test_sample_guard_and_line_length(spark, tmp_path):
    with pytest.raises(ValueError):
        training.train(samples(spark).limit(9))
    (tmp_path / "invoices.txt").write_text("x" * 20 + "\n  " + "y" * 21 + "  \n\n", encoding="utf-8")
    assert [tuple(r) for r in read_samples(spark, str(tmp_path)).collect()] == [("y" * 21, "Invoice")]
    assert read_samples(spark, str(tmp_path / "none")).count() == 0


def test_class_report_without_cases(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "a"), ("c", "a")]
    report = class_report(spark.createDataFrame(rows, "label string, predicted string"))
    got = {r.name: (r.precision, r.recall, r.f1, r.support) for r in report.collect()}
    assert got["a"] == pytest.approx((1 / 3, 1 / 2, 0.4, 2))
    assert got["c"] == (0.0, 0.0, 0.0, 1)
    assert got["accuracy"] == pytest.approx((0.25, 0.25, 0.25, 4))
    assert got["weighted avg"] == pytest.approx((1 / 6, 1 / 4, 0.2, 4))


def test_empty_text_scores_intercepts(spark):
    fitted = model.fit(samples(spark), stop_words=[], tolerance=1e-10)
    row = fitted.score(spark.createDataFrame([("",), ("!!",)], "text string")).collect()
    assert row[0].probabilities == row[1].probabilities


def test_words_of_arrow_batches_are_those_of_the_tokenizer(spark):
    """Letters with unusual small forms, digits of other scripts, bytes that are no UTF-8, stop words."""
    texts = ["İstanbul İki", "ΟΔΟΣ ΣΑΣ Σ", "a_1 x² ١٢ ½¾", "naïve café—the 中文 \U0001d400\U0001d401", "", None, "THE the _ __ a b"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    docs = docs.unionByName(spark.range(1).select(F.expr("cast(unhex('6161FF6262') as string)").alias("text")))
    rows = features.with_words(docs, ["the"]).select("words").collect()
    expected = Counter(word for row in rows for word in row.words)
    got = features._word_counts(docs.select(features.valid_text("text").alias("text")), ["the"]).collect()
    assert {r.term: r.n for r in got} == expected and expected["aa"] == 1


def test_a_long_document_costs_its_norm_once(spark):
    """The norm of a row is no part of a lambda, which would compute it for each weight."""
    weights = F.expr("transform(sequence(3, 4 + cast(id as int)), x -> cast(x as double))")
    normed = spark.range(1).select(weights.alias("w")).withColumn("norm", features.unit_length(F.col("w")))
    scaled = normed.select(features.scaled(F.col("w"), F.col("norm")).alias("x"))
    assert scaled.first().x == [0.6, 0.8]
    plan = scaled._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"lambda \S+ / lambda \S+", plan) and "/ CASE" not in plan


def test_margins_follow_weights_and_coefficients(spark):
    """The scores are those of the TF-IDF table and the coefficients, whatever shares a batch."""
    fitted = model.fit(samples(spark), stop_words=["the"])
    docs = samples(spark, 5, seed=3).withColumn("doc_id", F.monotonically_increasing_id()).drop("label")
    vocabulary = fitted.vectorizer.stages[-1].vocabulary
    table = features.tfidf_of(features.Vectorizer(fitted.vectorizer, None, vocabulary, fitted.idf), docs).collect()
    places, margins = {term: i for i, term in enumerate(vocabulary)}, {}
    for r in table:
        own = margins.setdefault(r.doc_id, list(fitted.intercepts))
        for k, row in enumerate(fitted.coefficients):
            own[k] += r.weight * row[places[r.term]]
    whole = {r.doc_id: r for r in fitted.score(docs).collect()}
    for doc, own in margins.items():
        shares = np.exp(np.array(own) - max(own))
        assert whole[doc].probabilities == pytest.approx((shares / shares.sum()).tolist())
        assert whole[doc].ml_label == fitted.labels[int(np.argmax(own))]
    alone = fitted.score(docs.repartition(7)).collect()
    assert {r.doc_id: r.probabilities for r in alone} == {d: r.probabilities for d, r in whole.items()}
