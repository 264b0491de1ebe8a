"""The document classifier: fit, score, save and load."""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IndexToString
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from doctriage import fixed
from doctriage.functions.numbers import round_half_even
from doctriage.operators import features
from doctriage.session import path_bytes, path_exists, stage, stages_folder

VECTOR_BYTES_PER_TASK = 16 * 1024 * 1024


@dataclass
class TextModel:
    """A fitted vectorizer and linear classifier, ready to score.

    The arrays are bounded by the vocabulary cap times the number of classes.  ``labels`` are in
    alphabetical order, so the first best class wins a tie.
    """

    vectorizer: PipelineModel
    idf: list[float]
    labels: list[str]
    coefficients: list[list[float]]
    intercepts: list[float]
    classifier: PipelineModel | None = None

    def score(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """Add ``ml_label``, ``ml_confidence`` (0-100, unrounded) and ``probabilities``.

        Row by row, without a shuffle: Arrow batches of texts give the margins, the JVM the rest.
        """
        margins = F.arrow_udf(self._margins(), "array<double>")
        scored = docs.withColumn("_margins", margins(features.valid_text(text)))
        return with_prediction(scored, "_margins", self.labels).select(
            *docs.columns, "ml_label", "ml_confidence", "probabilities"
        )

    def _margins(self):
        """A function that gives texts the margins of their classes; in the JVM these would be interpreted
        lambdas, and the optimizer puts some into others, so that weights are made over and over."""
        find = features.term_finder(self.vectorizer.stages[-1].vocabulary, features.stop_words_of(self.vectorizer))
        idf, tables, intercepts = np.array(self.idf), np.array(self.coefficients), list(self.intercepts)

        def of_part(texts: pa.Array) -> np.ndarray:
            rows, terms, counts = find(texts)
            weights = (np.log(counts) + 1.0) * idf[terms]
            # Sums in the order of the terms, whatever else is in the batch.
            total = lambda values: np.bincount(rows, values, len(texts))
            norm = np.sqrt(total(weights * weights))
            norm[norm == 0] = 1.0
            return np.column_stack([b + total(weights * row[terms]) / norm for row, b in zip(tables, intercepts)])

        def margins(texts: pa.Array) -> pa.Array:
            values = np.concatenate([of_part(part) for part in features.slices(texts)])
            starts = np.arange(len(texts) + 1) * len(intercepts)
            return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values.ravel()))

        return margins


def with_prediction(scored: DataFrame, margins: str, labels: Sequence[str]) -> DataFrame:
    """Softmax over an array of class margins: best label, confidence and probabilities."""
    best = F.array_max(margins)
    shares = F.transform(margins, lambda m: F.exp(m - F.col("_best")))
    total = F.aggregate("_shares", F.lit(0.0), lambda acc, x: acc + x)
    position = F.array_position(margins, F.col("_best")).cast("int")
    return (
        scored.withColumn("_best", best)
        .withColumn("_shares", shares)
        .withColumn("_total", total)
        .withColumn("ml_label", F.element_at(F.array(*[F.lit(name) for name in labels]), position))
        .withColumn("probabilities", F.transform("_shares", lambda x: x / F.col("_total")))
        .withColumn("ml_confidence", F.array_max("probabilities") * 100.0)
        .drop("_best", "_shares", "_total")
    )


def reported_confidence(confidence: Column) -> Column:
    return round_half_even(confidence, 1)


def is_test_sample(text: Column, seed: int = fixed.SPLIT_SEED) -> Column:
    """Deterministic share of the samples by content hash, independent of partitioning."""
    digest = F.md5(F.concat(text, F.lit(str(seed))))
    number = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return number % 100 < fixed.TEST_SHARE_PERCENT


def split_samples(samples: DataFrame, seed: int = fixed.SPLIT_SEED) -> tuple[DataFrame, DataFrame]:
    is_test = is_test_sample(F.col("text"), seed)
    return samples.filter(~is_test), samples.filter(is_test)


def fit(
    samples: DataFrame,
    stop_words: Sequence[str] | None = None,
    size: int = fixed.MAX_FEATURES,
    inverse_regularisation: float = fixed.INVERSE_REGULARISATION,
    max_iterations: int = fixed.MAX_ITERATIONS,
    tolerance: float = 1e-6,
) -> TextModel:
    """Fit TF-IDF and multinomial logistic regression on ``text, label``.

    The TF-IDF rows are written once as sparse vectors to the shared folder, since the solver
    passes over them many times.  Penalty: mean loss + |w|^2 / (2 C n), intercepts free.  The
    solver stops when a step improves the loss by less than ``tolerance`` of it.
    """
    spark = samples.sparkSession
    words = list(features.default_stop_words() if stop_words is None else stop_words)
    samples = stage(samples.select("label", "text"), "samples")
    vectorizer = features.fit_vectorizer(samples, words, size)
    labels = sorted(row["label"] for row in samples.select("label").distinct().collect())
    counted = features.with_counts(samples, vectorizer.stages)
    train = _sparse_vectors(spark, counted, vectorizer.idf, labels)
    rows = train.count()
    solver = LogisticRegression(
        family="multinomial",
        standardization=False,
        elasticNetParam=0.0,
        regParam=1.0 / (inverse_regularisation * rows),
        maxIter=max_iterations,
        tol=tolerance,
    )
    fitted = solver.fit(train)
    matrix = fitted.coefficientMatrix.toArray()
    classifier = PipelineModel(
        [fitted, IndexToString(inputCol="prediction", outputCol="ml_label", labels=labels)]
    )
    return TextModel(
        vectorizer=vectorizer.stages,
        idf=vectorizer.idf,
        labels=labels,
        coefficients=[[float(x) for x in row] for row in matrix],
        intercepts=[float(x) for x in fitted.interceptVector],
        classifier=classifier,
    )


def _sparse_vectors(
    spark: SparkSession, counted: DataFrame, idf: Sequence[float], labels: Sequence[str]
) -> DataFrame:
    """Unit-length TF-IDF rows as ``label, features``, written once as the columns a vector consists of."""
    weighted = counted.withColumn(
        "_weights", features.tfidf_weights(F.col("term_ids"), F.col("term_counts"), idf)
    ).withColumn("_norm", features.unit_length(F.col("_weights")))
    vector = F.struct(
        F.lit(0).cast("byte").alias("type"),  # sparse
        F.lit(len(idf)).alias("size"),
        F.col("term_ids").alias("indices"),
        features.scaled(F.col("_weights"), F.col("_norm")).alias("values"),
    )
    position = F.array_position(F.array(*[F.lit(name) for name in labels]), F.col("label")) - 1
    path = f"{stages_folder(spark)}/vectors-{uuid.uuid4().hex}"
    weighted.select(position.cast("double").alias("label"), vector.alias("features")).write.parquet(path)
    # The solver runs one job per step: tasks below this share would cost more than they compute.
    tasks = math.ceil(path_bytes(spark, path) / VECTOR_BYTES_PER_TASK)
    schema = StructType([StructField("label", DoubleType()), StructField("features", VectorUDT())])
    return spark.read.schema(schema).parquet(path).coalesce(max(1, tasks))


def save(model: TextModel, path: str) -> None:
    """Write the vectorizer and the classifier as two Spark ML pipelines, plus the IDF table."""
    spark = SparkSession.active()
    model.vectorizer.write().overwrite().save(f"{path}/vectorizer")
    model.classifier.write().overwrite().save(f"{path}/classifier")
    rows = spark.createDataFrame(list(enumerate(model.idf)), "term_id int, idf double")
    rows.write.mode("overwrite").parquet(f"{path}/idf")


def load(spark: SparkSession, path: str) -> TextModel | None:
    """The saved model, or None when any of its parts is missing."""
    if not all(path_exists(spark, f"{path}/{part}") for part in ("vectorizer", "classifier", "idf")):
        return None
    vectorizer = PipelineModel.load(f"{path}/vectorizer")
    classifier = PipelineModel.load(f"{path}/classifier")
    idf = [row["idf"] for row in spark.read.parquet(f"{path}/idf").orderBy("term_id").collect()]
    regression, names = classifier.stages
    return TextModel(
        vectorizer=vectorizer,
        idf=idf,
        labels=list(names.getLabels()),
        coefficients=[[float(x) for x in row] for row in regression.coefficientMatrix.toArray()],
        intercepts=[float(x) for x in regression.interceptVector],
        classifier=classifier,
    )
