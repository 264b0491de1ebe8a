"""Language identification by sparse multinomial logistic regression on character n-grams.

Letters are lower-cased, everything else becomes one blank.  Hashed 1- to 3-grams get TF-IDF
weights, with document frequencies from all learning documents.  The regression is trained by
follow-the-regularised-leader with elastic-net penalties on a bounded sample per language, and a
temperature is fitted on sampled documents that the training did not see.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doctriage.llm import grams

UNKNOWN = "und"
ORDERS, BUCKETS = 3, 1 << 15
BLANK = 32
KNOWN_IN = 0.01  # of a language's sampled documents, one at least: where its n-grams are known from
DAMP = np.positive  # plain counts: the language of most of a mixed text wins


@dataclass(frozen=True)
class Training:
    """``sample`` bounds the documents used for fitting, over all languages together; each of at
    most ``languages`` languages (the most frequent ones) gets an equal share of it.  One in
    ``calibration`` of them fits the temperature."""

    sample: int = 6000
    languages: int = 300
    calibration: int = 5
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 1e-4


@dataclass(frozen=True)
class Model:
    labels: tuple[str, ...]
    inverse: np.ndarray
    weights: np.ndarray  # terms x labels
    bias: np.ndarray
    temperature: float
    known: np.ndarray  # labels x terms

    def judge(self, text: str) -> tuple[str, float, float]:
        """Language of a text with a letter, its score, and the weighted share of the text's n-grams
        that are known in this language."""
        terms, values = grams.weights(letter_grams(text), self.inverse, DAMP)
        scores = values @ self.weights[terms] + self.bias
        likely = softmax(scores.astype(np.float64) / self.temperature)
        best = int(likely.argmax())
        known = float(values[self.known[best, terms]].sum() / values.sum())
        return self.labels[best], float(likely[best]), known


def letter_grams(text: str) -> np.ndarray:
    """n-gram counts of the letters of ``text``, blanks between words; all zero without a letter."""
    total = np.zeros(BUCKETS, np.int64)
    tail, after_letter = np.zeros(0, np.uint32), False
    for points in grams.code_points(text.lower()):
        is_letter = grams.letters()[points]
        kept = is_letter.copy()
        kept[1:] |= is_letter[:-1]  # the first of several other characters stays, as a blank
        kept[0] |= after_letter
        after_letter = is_letter[-1]
        own = np.concatenate([tail, np.where(is_letter, points, BLANK)[kept]])
        total += grams.count_grams(own, ORDERS, BUCKETS, len(tail))
        tail = own[max(0, len(own) - ORDERS + 1) :]
    return total


def has_letter(text: str) -> bool:
    return any(grams.letters()[points].any() for points in grams.code_points(text))


def softmax(scores: np.ndarray) -> np.ndarray:
    raised = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return raised / raised.sum(axis=-1, keepdims=True)


def fit_leader(
    rows: list[tuple[np.ndarray, np.ndarray, int]], size: int, labels: int, how: Training
) -> tuple[np.ndarray, np.ndarray]:
    """Weights (``size`` x ``labels``, sparse in value) and bias by follow-the-regularised-leader:
    every coordinate has its own rate, L1 sets weak ones to exactly zero."""
    z, n = np.zeros((size + 1, labels)), np.zeros((size + 1, labels))

    def current(at: np.ndarray) -> np.ndarray:
        pull = z[at]
        rate = (how.beta + np.sqrt(n[at])) / how.alpha + how.l2
        return np.where(np.abs(pull) <= how.l1, 0.0, (np.sign(pull) * how.l1 - pull) / rate)

    for _ in range(how.epochs):
        for terms, values, label in rows:
            at, x = np.append(terms, size), np.append(values, 1.0)  # the last term is the bias
            w = current(at)
            error = softmax(x @ w)
            error[label] -= 1
            gradient = x[:, None] * error
            squares = gradient * gradient
            z[at] += gradient - (np.sqrt(n[at] + squares) - np.sqrt(n[at])) / how.alpha * w
            n[at] += squares
    final = current(np.arange(size + 1))
    return final[:size].astype(np.float32), final[size].astype(np.float32)


def fit_temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, found by narrowing a logarithmic grid."""

    def loss(log_t: float) -> float:
        likely = softmax(scores / np.exp(log_t))[np.arange(len(labels)), labels]
        return float(-np.log(np.maximum(likely, 1e-12)).mean())

    if not len(labels):
        return 1.0
    low, high = np.log(0.1), np.log(20.0)
    for _ in range(5):
        grid = np.linspace(low, high, 21)
        best = int(np.argmin([loss(t) for t in grid]))
        low, high = grid[max(0, best - 1)], grid[min(20, best + 1)]
    return float(np.exp((low + high) / 2))


def drawn_texts(usable: DataFrame, ids: DataFrame) -> DataFrame:
    """``id, label, draw, text`` of the few drawn ``ids`` (``id, label, draw``), one row of those of
    ``usable`` that repeat an id and a label, however many they are."""
    same = (F.col("id") == F.col("doc_id")) & (F.col("label") == F.col("lang"))
    one = F.min(F.struct(F.xxhash64("text").alias("print"), "text")).alias("one")
    drawn = usable.join(F.broadcast(ids), same).groupBy("id", "label", "draw").agg(one)
    return drawn.select("id", "label", "draw", "one.text")


def learn(documents: DataFrame, how: Training = Training()) -> Model | None:
    """Fit on ``documents`` (``doc_id, text, lang``); None without a document that has both a
    language and a letter.  Which documents are sampled depends on a hash of their id only."""
    usable = documents.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).filter(
        "lang IS NOT NULL AND doc_id IS NOT NULL AND text IS NOT NULL"
    )
    counted = usable.groupBy("lang").agg(F.count("*").alias("n"))
    counts = counted.orderBy(F.desc("n"), "lang").limit(how.languages).collect()
    sizes = documents.sparkSession.createDataFrame([tuple(r) for r in counts], counted.schema)
    labels = sorted(r["lang"] for r in counts)
    if not labels:
        return None
    frequencies, total = grams.document_frequencies(usable, letter_grams, BUCKETS)
    inverse = grams.inverse_frequencies(frequencies, total)
    share = max(1, how.sample // len(labels))
    drawn = Window.partitionBy("lang").orderBy("draw", "doc_id")
    # Ids whose hash is far above the share of their language never reach the ranking.
    expected = F.lit(2.0 * share + 200) / F.col("n")
    low = F.xxhash64("doc_id").alias("draw")
    near = F.col("draw").cast("double") <= (expected - 0.5) * 2.0**64
    ids = (
        usable.filter(F.col("lang").isin(labels))
        .select("doc_id", "lang", low)
        .distinct()
        .join(F.broadcast(sizes), "lang")
        .filter(near)
        .withColumn("at", F.row_number().over(drawn))
        .filter(F.col("at") <= share)
        .select(F.col("doc_id").alias("id"), F.col("lang").alias("label"), "draw")
        .distinct()
    )
    # ``ids`` has how.sample rows at most, or one per language.
    rows = drawn_texts(usable, ids)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [grams.weights(letter_grams(t), inverse, DAMP) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {
                    "id": batch.column(0).cast(pa.int64()),
                    "label": batch.column(1),
                    "draw": batch.column(2),
                    "terms": pa.array([t.astype(np.int32).tobytes() for t, _ in made], pa.binary()),
                    "vals": pa.array([v.tobytes() for _, v in made], pa.binary()),
                }
            )

    def train(sample: pd.DataFrame) -> pd.DataFrame:
        # Hash order mixes the languages; the text's terms settle equal ids.
        sample = sample[sample["terms"].str.len() > 0].sort_values(["draw", "id", "label", "terms"])
        ready = [
            (np.frombuffer(t, np.int32), np.frombuffer(v, np.float32), labels.index(label))
            for t, v, label in zip(sample["terms"], sample["vals"], sample["label"])
        ]
        apart = ready[:: how.calibration] if len(ready) >= 10 * how.calibration else []
        rest = [r for i, r in enumerate(ready) if i % how.calibration] if apart else ready
        weights, bias = fit_leader(rest, BUCKETS, len(labels), how)
        scores = np.array([v @ weights[t] + bias for t, v, _ in apart]).reshape(-1, len(labels))
        heat = fit_temperature(scores, np.array([y for _, _, y in apart], int))
        counts = np.zeros((len(labels), BUCKETS), np.int32)
        for terms, _, label in ready:
            counts[label, terms] += 1
        sizes = np.bincount([y for _, _, y in ready], minlength=len(labels))
        known = np.packbits(counts >= np.maximum(1, KNOWN_IN * sizes)[:, None])
        return pd.DataFrame(
            {
                "weights": [weights.tobytes()], "bias": [bias.tobytes()], "heat": [heat],
                "known": [known.tobytes()], "n": [len(ready)],
            }
        )

    fitted = (
        rows.mapInArrow(vectors, "id long, label string, draw long, terms binary, vals binary")
        .withColumn("whole", F.lit(0))
        .groupBy("whole")  # the bounded sample
        .applyInPandas(train, "weights binary, bias binary, heat double, known binary, n long")
        .collect()
    )
    if not fitted or not fitted[0]["n"]:
        return None
    return Model(
        tuple(labels),
        inverse,
        np.frombuffer(fitted[0]["weights"], np.float32).reshape(BUCKETS, len(labels)),
        np.frombuffer(fitted[0]["bias"], np.float32),
        fitted[0]["heat"],
        np.unpackbits(np.frombuffer(fitted[0]["known"], np.uint8)).reshape(len(labels), BUCKETS).astype(bool),
    )


def _judged(documents: DataFrame, model: Model | None) -> DataFrame:
    """``documents`` with a struct ``_language`` of ``lang_pred, score, known``."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, known double")
    def run(texts: pd.Series) -> pd.DataFrame:
        model, out = shared.value, []
        for text in texts:
            if model is None or text is None or not has_letter(text):
                out.append((UNKNOWN, 0.0, 0.0))
            else:
                out.append(model.judge(text))
        return pd.DataFrame(out, columns=["lang_pred", "score", "known"])

    return documents.withColumn("_language", run(F.col("text")))


def predict(documents: DataFrame, model: Model | None) -> DataFrame:
    """``documents`` with ``lang_pred, score``, from the whole text alone.

    Texts that are null or hold no letter, and all texts without a model, get ``und`` and 0.
    Columns of these names that ``documents`` has are replaced.
    """
    rest = documents.drop("lang_pred", "score")
    return _judged(rest, model).select(*rest.columns, "_language.lang_pred", "_language.score")


def identify(documents: DataFrame, how: Training = Training()) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row.

    Learns from documents whose id's crc32 modulo 5 is not 0 and predicts all.  A null id is
    neither learned from nor held out.  Null or empty texts and texts without a letter are
    ``und`` with score 0; without anything to learn from, all are.  Repeated rows are predicted
    alike; further columns are ignored.
    """
    fold = grams.fold(F.col("doc_id"))
    model = learn(documents.filter(fold != 0), how)
    narrow = documents.select("doc_id", "text", F.coalesce(fold == 0, F.lit(False)).alias("held_out"))
    return predict(narrow, model).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(
    documents: DataFrame,
    least_score: float = 0.25,
    how: Training = Training(),
    least_known: float = 0.5,
) -> DataFrame:
    """``documents`` without those rejected: no language found, a score below ``least_score``, or
    less than ``least_known`` of the text's weighted n-grams known in the language found.

    The largest of a few scores is large whatever the text, so with up to ``1 / least_score``
    languages only the known share tells gibberish and languages that were not learned.
    """
    fold = grams.fold(F.col("doc_id"))
    model = learn(documents.filter(fold != 0), how)
    found = _judged(documents.select(F.struct("*").alias("_row"), "text"), model)
    found = found.select("_row", "_language.*")
    kept = found.filter(
        (F.col("lang_pred") != UNKNOWN)
        & (F.col("score") >= least_score)
        & (F.col("known") >= least_known)
    )
    return kept.select("_row.*")
