"""Terms, weights, scores, evaluation and the second opinion."""

from __future__ import annotations

import hashlib
import math
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doctriage.functions.text import py_strip
from doctriage.operators import evaluation, fallback, features, model, routing, validation
from doctriage.operators.validation import is_confident
from doctriage.plans import training
from doctriage.queries.registry import pick, query, sql_list, sql_round, sql_strip, table
from doctriage.session import shared_folder

# A short list shared with the SQL side; jobs default to Spark's English list.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "das", "de", "der", "des", "die",
    "el", "en", "est", "et", "for", "from", "had", "has", "he", "in", "is", "it", "la", "le",
    "les", "of", "on", "or", "that", "the", "to", "un", "und", "une", "was", "were", "with",
)
MAX_TERMS = 3000

TOKENS_SQL = f"""
words AS (
    SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'),
                               lambda t: t NOT IN ({sql_list(STOP_WORDS)})) AS w
    FROM documents
)"""
GRAMS_SQL = f"""
{TOKENS_SQL}, gram_lists AS (
    SELECT doc_id, w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])
                     || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS g
    FROM words
), grams AS (SELECT doc_id, unnest(g) AS term FROM gram_lists)"""
VOCABULARY_SQL = f"""
{GRAMS_SQL}, vocabulary AS (
    SELECT term, count(*) AS n FROM grams GROUP BY term ORDER BY n DESC, term LIMIT {MAX_TERMS}
)"""
WEIGHTS_SQL = f"""
{VOCABULARY_SQL}, tf AS (
    SELECT doc_id, term, count(*) AS tf FROM grams SEMI JOIN vocabulary USING (term) GROUP BY doc_id, term
), idf AS (
    SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM tf GROUP BY term
), raw AS (
    SELECT doc_id, term, tf, idf, (1 + ln(tf)) * idf AS w FROM tf JOIN idf USING (term)
), weights AS (
    SELECT doc_id, term, tf, idf, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM raw
)"""


def documents(spark, folder) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "text")


@query(f"WITH {TOKENS_SQL} SELECT doc_id, array_to_string(w, ' ') AS words, CAST(len(w) AS BIGINT) AS n FROM words")
def token_lists(spark, folder) -> DataFrame:
    return features.with_words(documents(spark, folder), STOP_WORDS).select(
        "doc_id", F.array_join("words", " ").alias("words"), F.size("words").cast("long").alias("n")
    )


@query(f"WITH {GRAMS_SQL} SELECT doc_id, array_to_string(g, '|') AS grams FROM gram_lists")
def ngram_lists(spark, folder) -> DataFrame:
    words = features.with_words(documents(spark, folder), STOP_WORDS)
    return features.with_grams(words).select("doc_id", F.array_join("grams", "|").alias("grams"))


@query(f"WITH {VOCABULARY_SQL} SELECT term, n FROM vocabulary")
def vocabulary(spark, folder) -> DataFrame:
    return features.term_counts(documents(spark, folder).select("text"), MAX_TERMS, stop_words=STOP_WORDS)


@query(f"WITH {WEIGHTS_SQL} SELECT doc_id, term, tf, round(idf, 6) AS idf, round(weight, 6) AS weight FROM weights")
def tfidf(spark, folder) -> DataFrame:
    weights = features.tfidf(documents(spark, folder), STOP_WORDS, MAX_TERMS)
    return weights.select(
        "doc_id", "term", "tf", F.round("idf", 6).alias("idf"), F.round("weight", 6).alias("weight")
    )


SPLIT_SQL = """
split AS (
    SELECT doc_id, text, ('0x' || substr(md5(text || '42'), 1, 8))::BIGINT % 100 < 20 AS is_test FROM documents
)"""


@query(f"WITH {SPLIT_SQL} SELECT doc_id, is_test FROM split")
def sample_split(spark, folder) -> DataFrame:
    return documents(spark, folder).select("doc_id", model.is_test_sample(F.col("text")).alias("is_test"))


@query(
    f"""
WITH {SPLIT_SQL}, {GRAMS_SQL}, train_grams AS (
    SELECT * FROM grams WHERE doc_id IN (SELECT doc_id FROM split WHERE NOT is_test)
), top_terms AS (
    SELECT term, count(*) AS n, count(DISTINCT doc_id) AS df FROM train_grams
    GROUP BY term ORDER BY n DESC, term LIMIT {MAX_TERMS}
), fitted AS (
    SELECT term, ln((1 + (SELECT count(*) FROM split WHERE NOT is_test)) / (1 + df)::DOUBLE) + 1 AS idf FROM top_terms
), raw AS (
    SELECT doc_id, term, (1 + ln(count(*))) * any_value(idf) AS w
    FROM grams JOIN fitted USING (term)
    WHERE doc_id IN (SELECT doc_id FROM split WHERE is_test) GROUP BY doc_id, term
)
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM raw
"""
)
def tfidf_unseen(spark, folder) -> DataFrame:
    """Vocabulary and IDF from the training share, weights of the held-out documents."""
    training_share, test = model.split_samples(documents(spark, folder))
    vectorizer = features.fit_vectorizer(training_share, STOP_WORDS, MAX_TERMS)
    return features.tfidf_of(vectorizer, test).select(
        "doc_id", "term", F.round("weight", 6).alias("weight")
    )


# A classifier whose coefficients come from a digest of term and label, so that both engines can
# write them down for whatever vocabulary the documents have.
CLASSES = ("Contract", "Invoice", "Paystub", "Resume")
INTERCEPTS = (0.0, 0.1, 0.2, 0.3)


def digest_coefficient(term: str, label: str) -> float:
    return (int(hashlib.md5(f"{term}|{label}".encode()).hexdigest()[:6], 16) % 2001 - 1000) / 100.0


def digest_model(spark, folder) -> model.TextModel:
    fitted = features.fit_vectorizer(documents(spark, folder), STOP_WORDS, MAX_TERMS)
    return model.TextModel(
        vectorizer=fitted.stages,
        idf=fitted.idf,
        labels=list(CLASSES),
        coefficients=[[digest_coefficient(term, label) for term in fitted.vocabulary] for label in CLASSES],
        intercepts=list(INTERCEPTS),
    )


SCORES_SQL = f"""
{WEIGHTS_SQL}, classes AS (
    SELECT unnest([{sql_list(CLASSES)}]) AS label, unnest([{', '.join(map(str, INTERCEPTS))}]) AS intercept
), sums AS (
    SELECT doc_id, label,
           sum(weight * ((('0x' || substr(md5(term || '|' || label), 1, 6))::BIGINT % 2001 - 1000) / 100.0::DOUBLE)) AS s
    FROM weights, classes GROUP BY doc_id, label
), margins AS (
    SELECT d.doc_id, c.label, c.intercept::DOUBLE + coalesce(s, 0) AS margin
    FROM documents d CROSS JOIN classes c LEFT JOIN sums ON sums.doc_id = d.doc_id AND sums.label = c.label
), softmax AS (
    SELECT doc_id, label, exp(margin - max(margin) OVER (PARTITION BY doc_id)) AS e FROM margins
), scores AS (
    SELECT doc_id, arg_max(label, e) AS ml_label, 100 * max(e) / sum(e) AS ml_confidence FROM softmax GROUP BY doc_id
)"""


@query(f"WITH {SCORES_SQL} SELECT doc_id, ml_label, round(ml_confidence, 6) AS ml_confidence FROM scores")
def scores(spark, folder) -> DataFrame:
    scored = digest_model(spark, folder).score(documents(spark, folder))
    return scored.select("doc_id", "ml_label", F.round("ml_confidence", 6).alias("ml_confidence"))


PROMPTS_SQL = f"""
prompts AS (
    SELECT doc_id, '{fallback.PROMPT_HEAD}' || left(text, 1000) || '{fallback.PROMPT_TAIL}' AS prompt FROM documents
)"""


@query(f"WITH {PROMPTS_SQL} SELECT doc_id, prompt FROM prompts")
def prompts(spark, folder) -> DataFrame:
    return documents(spark, folder).select("doc_id", fallback.prompt(F.col("text")).alias("prompt"))


ANSWERS = ("It is an INVOICE or a resume", "paystub", "A Contract!", "unknown", "no idea", "Invoice")
PARSE_SQL = """CASE WHEN contains(lower(answer), 'resume') THEN 'Resume'
    WHEN contains(lower(answer), 'invoice') THEN 'Invoice' WHEN contains(lower(answer), 'paystub') THEN 'Paystub'
    WHEN contains(lower(answer), 'contract') THEN 'Contract' ELSE 'Unknown' END"""


@query(
    f"""
WITH answers AS (
    SELECT conv_id, turn, text || ' ' || ([{sql_list(ANSWERS)}])[(conv_id + turn) % 6 + 1] AS answer FROM conversations
)
SELECT conv_id, turn, {PARSE_SQL} AS document_type FROM answers
"""
)
def parsed_answers(spark, folder) -> DataFrame:
    turns = table(spark, folder, "conversations")
    answer = F.concat("text", F.lit(" "), pick(ANSWERS, (F.col("conv_id") + F.col("turn")) % 6))
    return turns.select("conv_id", "turn", fallback.parse_answer(answer).alias("document_type"))


def responder_by_length():
    """A stand-in for the second model: the answer follows from the length of the prompt."""
    answers = ANSWERS

    def respond(questions):
        return [answers[len(question) % len(answers)] for question in questions]

    return respond


CLASSIFIED_SQL = f"""
{SCORES_SQL}, {PROMPTS_SQL}, answered AS (
    SELECT *, ([{sql_list(ANSWERS)}])[length(prompt) % 6 + 1] AS answer
    FROM scores JOIN prompts USING (doc_id)
), classified AS (
    SELECT doc_id, CASE WHEN ml_confidence >= 70 THEN ml_label ELSE {PARSE_SQL} END AS document_type,
           {sql_round('ml_confidence', 1)} AS confidence,
           CASE WHEN ml_confidence >= 70 THEN 'ML Model' ELSE 'Ollama AI' END AS method
    FROM answered
)"""
ROUTE_SQL = """CASE document_type WHEN 'Resume' THEN 'documents/hr/resumes' WHEN 'Invoice' THEN 'documents/finance/invoices'
    WHEN 'Paystub' THEN 'documents/finance/paystubs' WHEN 'Contract' THEN 'documents/legal/contracts'
    ELSE 'documents/unknown' END"""


@query(f"WITH {CLASSIFIED_SQL} SELECT *, {ROUTE_SQL} AS destination FROM classified")
def classified_documents(spark, folder) -> DataFrame:
    """Model first, second opinion below the threshold, then the folder."""
    scored = digest_model(spark, folder).score(documents(spark, folder))
    unsure = ~is_confident(F.col("ml_confidence"))
    answer = fallback.ask(F.when(unsure, fallback.prompt(F.col("text"))), responder_by_length())
    labelled = scored.withColumn("_answer", answer).withColumn(
        "document_type", F.when(unsure, fallback.parse_answer(F.col("_answer"))).otherwise(F.col("ml_label"))
    )
    return labelled.select(
        "doc_id",
        "document_type",
        model.reported_confidence(F.col("ml_confidence")).alias("confidence"),
        F.when(unsure, "Ollama AI").otherwise("ML Model").alias("method"),
        routing.destination(F.col("document_type")).alias("destination"),
    )


@query(f"WITH {SCORES_SQL} SELECT doc_id, CASE WHEN ml_confidence >= 70 THEN ml_label ELSE 'Unknown' END AS document_type FROM scores")
def classified_without_responder(spark, folder) -> DataFrame:
    scored = digest_model(spark, folder).score(documents(spark, folder))
    unsure = ~is_confident(F.col("ml_confidence"))
    answer = fallback.parse_answer(fallback.ask(F.col("text"), None))
    return scored.select("doc_id", F.when(unsure, answer).otherwise(F.col("ml_label")).alias("document_type"))


JUDGED_SQL = """
judged AS (
    SELECT CASE quality WHEN 1 THEN 'good' ELSE 'poor' END AS label,
           CASE toxic WHEN 1 THEN 'toxic' ELSE 'good' END AS predicted
    FROM labels
)"""


def judged(spark, folder) -> DataFrame:
    """Quality as truth against a rule that calls every document without toxic mark good."""
    return table(spark, folder, "labels").select(
        F.when(F.col("quality") == 1, "good").otherwise("poor").alias("label"),
        F.when(F.col("toxic") == 1, "toxic").otherwise("good").alias("predicted"),
    )


@query(f"WITH {JUDGED_SQL} SELECT round(avg((label = predicted)::INT), 9) AS accuracy FROM judged")
def accuracy(spark, folder) -> DataFrame:
    return evaluation.accuracy(judged(spark, folder)).select(F.round("accuracy", 9).alias("accuracy"))


@query(
    f"""
WITH {JUDGED_SQL}, names AS (SELECT label AS name FROM judged UNION SELECT predicted FROM judged),
counts AS (
    SELECT name, count(*) FILTER (WHERE label = name) AS support,
           count(*) FILTER (WHERE predicted = name) AS guessed,
           count(*) FILTER (WHERE label = name AND predicted = name) AS hits
    FROM judged, names GROUP BY name
), per_class AS (
    SELECT name, coalesce(hits / nullif(guessed, 0)::DOUBLE, 0) AS precision,
           coalesce(hits / nullif(support, 0)::DOUBLE, 0) AS recall,
           2 * hits / (guessed + support)::DOUBLE AS f1, support, hits FROM counts
), lines AS (
    SELECT name, precision, recall, f1, support FROM per_class
    UNION ALL SELECT 'accuracy', sum(hits) / sum(support)::DOUBLE, sum(hits) / sum(support)::DOUBLE,
                     sum(hits) / sum(support)::DOUBLE, sum(support)::BIGINT FROM per_class
    UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM per_class
    UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                     sum(f1 * support) / sum(support), sum(support)::BIGINT FROM per_class
)
SELECT name, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM lines
"""
)
def class_report(spark, folder) -> DataFrame:
    report = evaluation.class_report(judged(spark, folder))
    ratios = [F.round(name, 9).alias(name) for name in ("precision", "recall", "f1")]
    return report.select("name", *ratios, "support")


@query(
    f"""
WITH {JUDGED_SQL}
SELECT bool_and(label = predicted) AS all_correct, count(*) FILTER (WHERE label = predicted) AS correct,
       count(*) AS total FROM judged
"""
)
def expected_score(spark, folder) -> DataFrame:
    return evaluation.score_expected(judged(spark, folder), "label", "predicted")


def labelled_documents(spark, folder) -> DataFrame:
    """Labelled documents as training samples: quality decides the label."""
    quality = table(spark, folder, "labels").select(
        "doc_id", F.when(F.col("quality") == 1, "good").otherwise("poor").alias("label")
    )
    return documents(spark, folder).join(quality, "doc_id")


@query()
def trained_predictions(spark, folder) -> DataFrame:
    """Train on the labelled documents, save, load and predict every document."""
    path = f"{shared_folder(spark)}/models/{uuid.uuid4().hex}"
    training.train(labelled_documents(spark, folder), path, stop_words=STOP_WORDS)
    loaded = model.load(spark, path)
    return training.predict(loaded, documents(spark, folder)).select(
        "doc_id", "predicted", F.round("ml_confidence", 4).alias("confidence")
    )


@query(
    f"""
WITH {SPLIT_SQL}
SELECT CASE quality WHEN 1 THEN 'good' ELSE 'poor' END AS label, count(*) AS held_out, count(*) AS support,
       TRUE AS sums_to_one, TRUE AS same_after_load, TRUE AS at_the_optimum, TRUE AS better_than_guessing
FROM split s JOIN labels USING (doc_id) WHERE s.is_test GROUP BY quality
"""
)
def training_checks(spark, folder) -> DataFrame:
    """Per label what was held out and reported; whether the loaded model predicts the same, whether the
    fit has reached the optimum of its loss, and whether that is below the loss of the labels' shares."""
    path = f"{shared_folder(spark)}/models/{uuid.uuid4().hex}"
    labelled = labelled_documents(spark, folder).select("doc_id", "text", "label")
    trained = training.train(labelled, path, stop_words=STOP_WORDS, tolerance=1e-10)
    fitted_on, _ = model.split_samples(labelled)
    gradient = evaluation.largest_gradient(trained.model, fitted_on).first()["gradient"]
    held_out = trained.predictions.select("doc_id", "text", "label", F.col("predicted").alias("before"))
    again = training.predict(model.load(spark, path), held_out)
    total = F.aggregate("probabilities", F.lit(0.0), lambda acc, x: acc + x)
    per_label = again.groupBy("label").agg(
        F.count("*").alias("held_out"),
        F.bool_and(F.abs(total - 1) < 1e-9).alias("sums_to_one"),
        F.bool_and(F.col("predicted") == F.col("before")).alias("same_after_load"),
    )
    scored = trained.model.score(fitted_on)
    names = F.array(*[F.lit(name) for name in trained.model.labels])
    own = F.get("probabilities", F.array_position(names, F.col("label")).cast("int") - 1)
    loss = scored.agg(F.avg(-F.log(own))).first()[0]
    shares = fitted_on.groupBy("label").count().agg(F.collect_list("count")).first()[0]  # a number per label
    guessing = -sum(n / sum(shares) * math.log(n / sum(shares)) for n in shares)
    return per_label.join(trained.report.select(F.col("name").alias("label"), "support"), "label").select(
        "*", F.lit(gradient < 1e-6).alias("at_the_optimum"), F.lit(loss < guessing).alias("better_than_guessing")
    )


@query(
    """
SELECT size, part, count(*) AS n, count(*) >= 10 AS enough FROM (
    SELECT unnest([9, 10]) AS size, doc_id FROM documents
), LATERAL (SELECT CAST(doc_id // size AS BIGINT) AS part) GROUP BY size, part
"""
)
def minimum_samples(spark, folder) -> DataFrame:
    """Groups of nine and of ten samples: ten are enough for training."""
    sizes = F.explode(F.array(F.lit(9), F.lit(10))).alias("size")
    samples = documents(spark, folder).select("doc_id", sizes)
    groups = samples.groupBy("size", F.floor(F.col("doc_id") / F.col("size")).cast("long").alias("part"))
    return groups.agg(F.count("*").alias("n")).withColumn("enough", validation.enough_samples(F.col("n")))


@query()
def training_report(spark, folder) -> DataFrame:
    """Held-out report of the trained classifier."""
    return training.train(labelled_documents(spark, folder), stop_words=STOP_WORDS).report


@query(
    f"""
WITH {SPLIT_SQL}
SELECT quality, s.is_test, count(*) AS n, count(DISTINCT {sql_strip('text')}) AS texts
FROM split s JOIN labels USING (doc_id) GROUP BY quality, s.is_test
"""
)
def split_sizes(spark, folder) -> DataFrame:
    samples = documents(spark, folder).join(table(spark, folder, "labels"), "doc_id")
    marked = samples.withColumn("is_test", model.is_test_sample(F.col("text")))
    return marked.groupBy("quality", "is_test").agg(
        F.count("*").alias("n"), F.countDistinct(py_strip(F.col("text"))).alias("texts")
    )
