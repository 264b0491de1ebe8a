"""Accuracy, per-class report and smoke checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doctriage import fixed
from doctriage.operators import features
from doctriage.operators.model import TextModel


def accuracy(predictions: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    hit = F.when(F.col(label) == F.col(predicted), 1.0).otherwise(0.0)
    return predictions.agg(F.avg(hit).alias("accuracy"))


def class_report(
    predictions: DataFrame, label: str = "label", predicted: str = "predicted"
) -> DataFrame:
    """Rows per class plus ``accuracy``, ``macro avg`` and ``weighted avg``.

    Columns ``name, precision, recall, f1, support``.  The data is reduced to its confusion
    counts first; all that follows works on at most classes x classes rows.  A ratio without
    cases is 0.  For ``accuracy`` all three ratios hold the accuracy.
    """
    confusion = predictions.groupBy(
        F.col(label).cast("string").alias("truth"), F.col(predicted).cast("string").alias("guess")
    ).agg(F.count("*").alias("n"))
    hit = F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(F.lit(0))
    none = F.lit(0).cast("long")

    def side(name, support, guessed, hits):
        values = (F.col(name), support, guessed, hits.cast("long"))
        return F.struct(*[v.alias(n) for v, n in zip(values, ("name", "support", "guessed", "hits"))])

    sides = F.array(side("truth", F.col("n"), none, hit), side("guess", none, F.col("n"), none))
    totals = (
        confusion.select(F.explode(sides).alias("s"))
        .groupBy("s.name")
        .agg(*[F.sum(f"s.{field}").alias(field) for field in ("support", "guessed", "hits")])
    )

    def ratio(top, bottom):
        return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))

    per_class = totals.select(
        "name",
        ratio(F.col("hits"), F.col("guessed")).alias("precision"),
        ratio(F.col("hits"), F.col("support")).alias("recall"),
        ratio(2 * F.col("hits"), F.col("guessed") + F.col("support")).alias("f1"),
        "support",
        "hits",
    )
    weight = F.col("support")
    summary = per_class.agg(
        *[F.avg(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")],
        *[ratio(F.sum(F.col(m) * weight), F.sum(weight)).alias(f"weighted_{m}") for m in ("precision", "recall", "f1")],
        ratio(F.sum("hits"), F.sum(weight)).alias("share"),
        F.sum(weight).alias("support"),
    )

    def line(name, columns):
        values = [F.col(c).alias(m) for c, m in zip(columns, ("precision", "recall", "f1"))]
        return F.struct(F.lit(name).alias("name"), *values, F.col("support"))

    lines = F.array(
        line("accuracy", ["share"] * 3),
        line("macro avg", ["macro_precision", "macro_recall", "macro_f1"]),
        line("weighted avg", ["weighted_precision", "weighted_recall", "weighted_f1"]),
    )
    return per_class.drop("hits").unionByName(summary.select(F.inline(lines)))


def score_expected(predictions: DataFrame, expected: str = "expected", predicted: str = "predicted") -> DataFrame:
    """One row: ``all_correct``, ``correct`` and ``total`` over labelled examples."""
    ok = F.coalesce(F.col(expected) == F.col(predicted), F.lit(False))
    return predictions.agg(
        F.coalesce(F.bool_and(ok), F.lit(True)).alias("all_correct"),
        F.count_if(ok).alias("correct"),
        F.count("*").alias("total"),
    )


def largest_gradient(fitted: TextModel, samples: DataFrame, inverse_regularisation: float = fixed.INVERSE_REGULARISATION) -> DataFrame:
    """One row ``gradient``: the largest entry of the gradient of the penalised loss on ``text, label``.

    It is zero at the optimum.  Each sample adds its residuals to its terms; the sums are partial
    aggregates, and no more rows than the vocabulary has terms are joined with the weights.
    """
    spark, classes = samples.sparkSession, range(len(fitted.labels))
    rows = samples.count()
    scored = fitted.score(samples.select("text", "label"))
    counted = features.with_counts(scored.select("label", "probabilities", "text"), fitted.vectorizer)
    weights = features.tfidf_weights(F.col("term_ids"), F.col("term_counts"), fitted.idf)
    counted = counted.withColumn("weights", weights).withColumn("norm", features.unit_length(F.col("weights")))
    wrong = [
        (F.get("probabilities", F.lit(k)) - (F.col("label") == name).cast("double")).alias(f"r{k}")
        for k, name in enumerate(fitted.labels)
    ]
    residuals = counted.select("*", *wrong)
    # The last term stands for the intercepts, which are not penalised.
    cells = F.concat(
        F.arrays_zip(F.col("term_ids").alias("term"), features.scaled(F.col("weights"), F.col("norm")).alias("x")),
        F.array(F.struct(F.lit(len(fitted.idf)).alias("term"), F.lit(1.0).alias("x"))),
    )
    each = residuals.select(*[f"r{k}" for k in classes], F.inline(cells))
    sums = each.groupBy("term").agg(*[F.sum(F.col("x") * F.col(f"r{k}")).alias(f"s{k}") for k in classes])
    pull = [[*(row[t] for row in fitted.coefficients)] for t in range(len(fitted.idf))] + [[0.0] * len(fitted.labels)]
    table = spark.createDataFrame([(t, *row) for t, row in enumerate(pull)], "term int, " + ", ".join(f"w{k} double" for k in classes))
    joined = table.join(sums, "term", "left")
    entries = [F.abs(F.coalesce(f"s{k}", F.lit(0.0)) / rows + F.col(f"w{k}") / (inverse_regularisation * rows)) for k in classes]
    return joined.agg(F.max(F.greatest(*entries)).alias("gradient"))
