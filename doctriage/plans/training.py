"""Training: guard, split, fit, evaluate, save, smoke check."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doctriage.operators import evaluation, model
from doctriage.operators.validation import require_samples
from doctriage.session import stage


@dataclass
class Training:
    model: model.TextModel
    predictions: DataFrame
    accuracy: float
    report: DataFrame


def predict(fitted: model.TextModel, samples: DataFrame) -> DataFrame:
    return fitted.score(samples).withColumnRenamed("ml_label", "predicted")


def train(samples: DataFrame, path: str | None = None, **settings) -> Training:
    """Fit on the training share of ``text, label`` and evaluate on the rest."""
    require_samples(samples.count())
    training, test = model.split_samples(samples)
    fitted = model.fit(training, **settings)
    predictions = stage(predict(fitted, test), "predictions")
    if path:
        model.save(fitted, path)
    accuracy = evaluation.accuracy(predictions).first()["accuracy"]
    return Training(fitted, predictions, accuracy, evaluation.class_report(predictions))


def smoke_check(fitted: model.TextModel, examples: DataFrame) -> DataFrame:
    """``all_correct, correct, total`` over ``text, expected``."""
    return evaluation.score_expected(predict(fitted, examples.select("text", F.col("expected"))))
