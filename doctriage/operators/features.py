"""Terms, vocabulary and TF-IDF weights."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel, NGram, RegexTokenizer, SQLTransformer, StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doctriage import fixed
from doctriage.session import stage

PRUNING_WORDS = 20_000
# Rows whose n-grams are tallied at once; a key of three words and a row fit in 63 bits.
TALLIED_ROWS = 10_000
PART_BYTES = 16 * 1024 * 1024
# What is between words, for Arrow's kernels; ``TOKEN_PATTERN`` says the same to the JVM.
NO_WORD = r"[^\p{L}\p{N}_]+"


def default_stop_words() -> list[str]:
    """Spark's own English list; any other list can be passed wherever this one is used."""
    return StopWordsRemover.loadDefaultStopWords("english")


def word_stages(stop_words: Sequence[str], text: str = "text") -> list:
    """``words``: lower-cased runs of two or more word characters without the stop words."""
    return [
        SQLTransformer(statement=f"SELECT *, coalesce({text}, '') AS filled FROM __THIS__"),
        RegexTokenizer(
            inputCol="filled", outputCol="tokens", gaps=False, pattern=fixed.TOKEN_PATTERN, toLowercase=True
        ),
        StopWordsRemover(
            inputCol="tokens", outputCol="words", stopWords=list(stop_words), caseSensitive=True
        ),
    ]


def gram_stages(words: str = "words") -> list:
    """``grams``: all 1..3-grams of the word array, space-joined, shortest first."""
    longer = range(2, fixed.MAX_NGRAM + 1)
    joined = ", ".join([words, *[f"grams{n}" for n in longer]])
    return [
        *[NGram(n=n, inputCol=words, outputCol=f"grams{n}") for n in longer],
        SQLTransformer(statement=f"SELECT *, concat({joined}) AS grams FROM __THIS__"),
    ]


def with_words(docs: DataFrame, stop_words: Sequence[str], text: str = "text") -> DataFrame:
    columns = docs.columns
    return PipelineModel(word_stages(stop_words, text)).transform(docs).select(*columns, "words")


def with_grams(docs: DataFrame, words: str = "words") -> DataFrame:
    columns = docs.columns
    return PipelineModel(gram_stages(words)).transform(docs).select(*columns, "grams")


def term_counts(
    docs: DataFrame, size: int = fixed.MAX_FEATURES, pruning_words: int = PRUNING_WORDS, stop_words: Sequence[str] = ()
) -> DataFrame:
    """The ``size`` most frequent terms of ``text`` without the stop words, or of ``words``, as
    ``term, n``, by count, then by term.

    An n-gram is at most as frequent as each of its words.  So the count of the ``size``-th most
    frequent single word is a floor for every selected term, and n-grams holding a rarer word
    are dropped before the shuffle.  Without this, the shuffle would carry nearly every 2- and
    3-gram of the corpus.  When too many words reach the floor all n-grams are counted.
    """
    return _terms(docs, size, pruning_words, stop_words).select("term", "n")


def _terms(
    docs: DataFrame, size: int, pruning_words: int = PRUNING_WORDS, stop_words: Sequence[str] = ()
) -> DataFrame:
    """The rows of ``term_counts`` with ``df``, the number of documents that hold the term; null where
    all n-grams were counted."""
    has_words = "words" in docs.columns
    docs = docs.select("words") if has_words else docs.select(valid_text("text").alias("text"))
    counts = stage(_word_counts(docs, stop_words), "word-counts")
    top = counts.orderBy(F.desc("n"), "term").limit(size)
    floor = top.agg(F.count("*").alias("found"), F.min("n").alias("floor")).first()
    if floor["found"] == size and floor["floor"] > 1:
        frequent = counts.filter(F.col("n") >= floor["floor"]).limit(pruning_words + 1).collect()
        if len(frequent) <= pruning_words:
            grams = _frequent_grams(docs, sorted(row["term"] for row in frequent), floor["floor"], stop_words)
            return grams.orderBy(F.desc("n"), "term").limit(size)
    words = docs if has_words else with_words(docs, stop_words).select("words")
    grams = _each("grams", with_grams(words)).groupBy("term").agg(F.count("*").alias("n"))
    return grams.withColumn("df", F.lit(None).cast("long")).orderBy(F.desc("n"), "term").limit(size)


def valid_text(text: str) -> Column:
    """A text column as the Arrow kernels need it: bytes that are no UTF-8 become replacement characters."""
    return F.make_valid_utf8(F.col(text))


def _word_counts(docs: DataFrame, stop_words: Sequence[str]) -> DataFrame:
    """``term, n`` of all words, counted by Arrow batches before they are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(0)):
                words, _, kept = _words(part, stop_words)
                found = words.filter(pa.array(kept)).drop_null().value_counts()
                yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["term", "n"])

    return docs.mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _frequent_grams(docs: DataFrame, kept: Sequence[str], floor: int, stop_words: Sequence[str]) -> DataFrame:
    """``term, n, df`` of the n-grams of ``kept`` words that occur ``floor`` times or more.

    Each Arrow batch is tallied by numbers for the words before its rows are shuffled."""
    base = len(kept) + 1

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(0)):
                ids, rows = _word_ids(part, kept, stop_words)
                cells = [key * TALLIED_ROWS + rows[at] for at, key in _gram_keys(ids, rows, base)]
                cells, n = np.unique(np.concatenate(cells), return_counts=True)
                keys, starts, df = np.unique(cells // TALLIED_ROWS, return_index=True, return_counts=True)
                n = np.add.reduceat(n, starts) if len(n) else n
                columns = [pa.array(values, pa.int64()) for values in (keys, n, df)]
                yield pa.RecordBatch.from_arrays(columns, ["key", "n", "df"])

    tallied = docs.mapInArrow(tally, "key long, n long, df long")
    tallied = tallied.groupBy("key").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    names = F.from_json(F.lit(json.dumps(list(kept))), "array<string>")
    places = [base**power for power in reversed(range(fixed.MAX_NGRAM))]
    parts = [F.get(names, F.expr(f"CAST(key div {place} % {base} - 1 AS INT)")) for place in places]
    return tallied.filter(F.col("n") >= floor).select(F.concat_ws(" ", *parts).alias("term"), "n", "df")


def slices(column: pa.Array) -> Iterator[pa.Array]:
    """A column in consecutive parts of few rows and about ``PART_BYTES``."""
    step = max(1, min(TALLIED_ROWS, PART_BYTES * len(column) // max(1, column.nbytes)))
    for first in range(0, max(1, len(column)), step):
        yield column.slice(first, step)


def _words(column: pa.Array, stop_words: Sequence[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of texts, or of word arrays, one after another, their rows, and which of them count:
    of texts those of two or more characters that are no stop words, as ``word_stages`` makes them."""
    if isinstance(column, pa.ListArray):
        words, sizes = column.flatten(), pc.fill_null(pc.list_value_length(column), 0)
        kept = np.ones(len(words), bool)
    else:
        texts = pc.fill_null(column, "")
        lower = pc.utf8_lower(texts)
        # The letters whose small form is two characters or depends on what is around them.
        special = pc.match_substring_regex(texts, "[\u0130\u03a3]")
        if pc.any(special).as_py():
            lower = pc.replace_with_mask(lower, special, pa.array([t.lower() for t in texts.filter(special).to_pylist()], lower.type))
        split = pc.split_pattern(pc.replace_substring_regex(lower, NO_WORD, " "), " ")
        words, sizes = split.flatten(), pc.list_value_length(split)
        stopped = pc.is_in(words, value_set=pa.array(stop_words, words.type))
        kept = pc.and_not(pc.greater(pc.utf8_length(words), 1), stopped).to_numpy(zero_copy_only=False)
    return words, np.repeat(np.arange(len(column)), sizes.to_numpy(zero_copy_only=False)), kept


def _word_ids(column: pa.Array, known: Sequence[str], stop_words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Per word of texts or word arrays its number among ``known`` (from 1; 0: none of them) and its row."""
    words, rows, kept = _words(column, stop_words)
    found = pc.fill_null(pc.index_in(words, value_set=pa.array(known, words.type)), -1)
    return found.to_numpy(zero_copy_only=False)[kept].astype(np.int64) + 1, rows[kept]


def _gram_keys(ids: np.ndarray, rows: np.ndarray, base: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per length of n-grams, where those of known words start, and their keys: the numbers of their
    words as digits to ``base``, with zeros for what a shorter one lacks."""
    at = np.flatnonzero(ids)
    key = ids[at]
    for length in range(1, fixed.MAX_NGRAM + 1):
        if length > 1:
            end = at + (length - 1)
            inside = end < len(ids)
            at, key, end = at[inside], key[inside], end[inside]
            whole = (ids[end] > 0) & (rows[end] == rows[at])
            at, key = at[whole], key[whole] * base + ids[end[whole]]
        yield at, key * base ** (fixed.MAX_NGRAM - length)


def _each(array: str, rows: DataFrame, name: str = "term") -> DataFrame:
    """One row per element.  A plain explode would make the optimizer add a size filter below it,
    and that filter would run the whole tokenizer a second time."""
    return rows.select(F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def stop_words_of(stages: PipelineModel) -> list[str]:
    return next((list(s.getStopWords()) for s in stages.stages if isinstance(s, StopWordsRemover)), [])


def with_counts(docs: DataFrame, stages: PipelineModel, source: str = "text") -> DataFrame:
    """Replace ``source`` by ``term_ids array<int>`` and ``term_counts array<double>``.

    ``stages`` are those of a ``Vectorizer``; their terms are counted by Arrow batches of texts, as the
    stages would do it row by row.  This needs no shuffle.
    """
    count = F.arrow_udf(_term_counter(stages.stages[-1].vocabulary, stop_words_of(stages)), _COUNTS)
    counted = docs.withColumn("_counts", count(valid_text(source)))
    return counted.select(
        *[name for name in docs.columns if name != source],
        F.col("_counts.indices").alias("term_ids"),
        F.col("_counts.values").alias("term_counts"),
    )


_COUNTS = "indices array<int>, values array<double>"


def term_finder(vocabulary: Sequence[str], stop_words: Sequence[str]):
    """A function of a few texts that gives the cells of their term table as ``rows, term ids, counts``,
    by row and term, as the count vectorizer of that vocabulary fills it."""
    terms = [term.split(" ") for term in vocabulary]
    words = sorted({word for term in terms for word in term})
    number, base, size = {word: i for i, word in enumerate(words, 1)}, len(words) + 1, len(terms)
    digits = [[number[word] for word in term] + [0] * (fixed.MAX_NGRAM - len(term)) for term in terms]
    own = np.array(digits, np.int64) @ np.array([base**power for power in reversed(range(fixed.MAX_NGRAM))], np.int64)
    term_of = np.argsort(own)
    keys = own[term_of]

    def find(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, rows = _word_ids(texts, words, stop_words)
        cells = []
        for at, key in _gram_keys(ids, rows, base):
            spot = np.minimum(np.searchsorted(keys, key), size - 1)
            hit = keys[spot] == key
            cells.append(rows[at[hit]] * size + term_of[spot[hit]])
        found, n = np.unique(np.concatenate(cells), return_counts=True)
        return found // size, found % size, n

    return find


def _term_counter(vocabulary: Sequence[str], stop_words: Sequence[str]):
    """The cells of texts as arrays of each row."""
    find = term_finder(vocabulary, stop_words)

    def count(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([count_part(part) for part in slices(texts)])

    def count_part(texts: pa.Array) -> pa.Array:
        rows, terms, n = find(texts)
        starts = pa.array(np.searchsorted(rows, np.arange(len(texts) + 1)), pa.int32())
        indices = pa.ListArray.from_arrays(starts, pa.array(terms, pa.int32()))
        values = pa.ListArray.from_arrays(starts, pa.array(n, pa.float64()))
        return pa.StructArray.from_arrays([indices, values], ["indices", "values"])

    return count


def number_array(values: Sequence[float]) -> Column:
    """A long array literal; folded once instead of built from thousands of literals."""
    return F.from_json(F.lit("[" + ",".join(repr(float(v)) for v in values) + "]"), "array<double>")


def tfidf_weights(term_ids: Column, counts: Column, idf: Sequence[float]) -> Column:
    """Unnormalised weights ``(1 + ln tf) * idf`` aligned with ``term_ids``."""
    table = number_array(idf)
    return F.zip_with(term_ids, counts, lambda i, n: (F.log(n) + 1.0) * F.get(table, i))


def unit_length(weights: Column) -> Column:
    """Euclidean norm of the weights, 1.0 for an empty row so that it stays empty."""
    squares = F.aggregate(weights, F.lit(0.0), lambda total, w: total + w * w)
    return F.when(squares > 0, F.sqrt(squares)).otherwise(F.lit(1.0))


def scaled(weights: Column, norm: Column) -> Column:
    """Weights over their norm.  As an argument the norm is computed once for a row; in the body of a
    lambda, where the optimizer may put its whole expression, once for each weight."""
    return F.zip_with(weights, F.array_repeat(norm, F.size(weights)), lambda w, n: w / n)


def smoothed_idf(documents: Column, frequency: Column) -> Column:
    return F.log((documents + 1) / (frequency + 1)) + 1.0


def document_frequencies(counted: DataFrame) -> DataFrame:
    """``term_id, df`` from rows with ``term_ids``."""
    return _each("term_ids", counted, "term_id").groupBy("term_id").agg(F.count("*").alias("df"))


@dataclass
class Vectorizer:
    """Fitted counting stages, from text and from words, their vocabulary and its IDF."""

    stages: PipelineModel
    word_stages: PipelineModel
    vocabulary: list[str]
    idf: list[float]


def fit_vectorizer(
    docs: DataFrame, stop_words: Sequence[str], size: int = fixed.MAX_FEATURES, text: str = "text"
) -> Vectorizer:
    """Vocabulary and IDF of ``docs``, which are read several times: splitting texts into words again costs
    less than writing the words."""
    docs = docs.select(F.col(text).alias("text"))
    documents = docs.count()
    terms = _terms(docs, size, stop_words=stop_words)
    found = terms.withColumn("idf", smoothed_idf(F.lit(documents), F.col("df"))).collect()
    vocabulary = [row["term"] for row in found]
    counter = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="counts")
    from_words = PipelineModel([*gram_stages(), counter])
    stages = PipelineModel([*word_stages(stop_words), *from_words.stages])
    idf = [row["idf"] for row in found]
    if None in idf:
        idf = fit_idf(with_counts(docs, stages), len(vocabulary))
    return Vectorizer(stages=stages, word_stages=from_words, vocabulary=vocabulary, idf=idf)


def long_weights(vectorizer: Vectorizer, counted: DataFrame) -> DataFrame:
    """Rows ``term, tf, idf, weight`` with the other columns of counted documents."""
    others = [name for name in counted.columns if name not in ("term_ids", "term_counts")]
    weighted = counted.withColumn(
        "_weights", tfidf_weights(F.col("term_ids"), F.col("term_counts"), vectorizer.idf)
    ).withColumn("_norm", unit_length(F.col("_weights")))
    names = F.from_json(F.lit(json.dumps(vectorizer.vocabulary)), "array<string>")
    cells = F.explode_outer(F.arrays_zip("term_ids", "term_counts", "_weights")).alias("cell")
    found = weighted.select(*others, "_norm", cells).filter(F.col("cell.term_ids").isNotNull())
    return found.select(
        *others,
        F.get(names, F.col("cell.term_ids")).alias("term"),
        F.col("cell.term_counts").cast("long").alias("tf"),
        F.get(number_array(vectorizer.idf), F.col("cell.term_ids")).alias("idf"),
        (F.col("cell._weights") / F.col("_norm")).alias("weight"),
    )


def tfidf(
    docs: DataFrame, stop_words: Sequence[str], size: int = fixed.MAX_FEATURES, text: str = "text"
) -> DataFrame:
    """Fit on ``docs`` and return their own TF-IDF table."""
    return tfidf_of(fit_vectorizer(docs, stop_words, size, text), docs, text)


def tfidf_of(vectorizer: Vectorizer, docs: DataFrame, text: str = "text") -> DataFrame:
    """TF-IDF table of any documents; terms the vectorizer does not know are dropped."""
    return long_weights(vectorizer, with_counts(docs, vectorizer.stages, text))


def fit_idf(counted: DataFrame, size: int) -> list[float]:
    """Smoothed IDF per term id; the collected table has at most ``size`` rows."""
    documents = counted.count()
    rows = (
        document_frequencies(counted)
        .withColumn("idf", smoothed_idf(F.lit(documents), F.col("df")))
        .collect()
    )
    idf = [0.0] * size
    for row in rows:
        idf[row["term_id"]] = row["idf"]
    return idf
