"""The triage job over a set of files: validate, fingerprint, read, classify, route, report."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from doctriage import fixed
from doctriage.operators import fallback as second
from doctriage.operators.duplicates import fingerprint, mark_duplicates
from doctriage.operators.extraction import Parser, extract_text
from doctriage.operators.model import TextModel, reported_confidence
from doctriage.operators.naming import assign_names
from doctriage.operators.routing import outcome, registerable, verify_arrival, with_outcome_columns
from doctriage.operators.skew import join_facts
from doctriage.operators.validation import check_file, is_confident, is_non_document
from doctriage.session import stage
from doctriage.sources.files import arrival_order, dealt, fetch, list_folder, read_folder, with_names

RESULT_SCHEMA = StructType()
for _name in (
    "arrival_seq:long", "path", "file_name", "file_ext", "length:long", "md5", "check_status",
    "outcome", "status", "document_type", "confidence:double", "method", "destination",
    "final_name", "name_number:long", "registered:boolean", "report_type", "report_duplicate",
    "report_readable", "report_destination", "report_status",
):
    RESULT_SCHEMA.add(*(_name if ":" in _name else f"{_name}:string").split(":"))


@dataclass
class Settings:
    """What a deployment may change."""

    model: TextModel | None = None
    responder: second.Responder | None = None
    parsers: Mapping[str, Parser] = field(default_factory=dict)
    routes: Mapping[str, str] = field(default_factory=lambda: dict(fixed.ROUTES))
    threshold: float = fixed.CONFIDENCE_THRESHOLD
    # Whether copies of a content share one parse; by default where there are parsers.
    parse_contents_once: bool | None = None


# A table of the past, or a function that looks up what it knows of the rows at hand.
Known = DataFrame | Callable[[DataFrame], DataFrame] | None


def content_facts(files: DataFrame, settings: Settings) -> DataFrame:
    """Replace ``text`` by what follows from it: readable, label, confidence, prompt.

    Row by row, no shuffle.  Uncertain documents keep the prompt for the second opinion, a string
    of bounded length.
    """
    readable = F.col("text").isNotNull()
    classifiable = readable & ~is_non_document(F.col("file_ext"))
    facts = files.withColumn("readable", readable)
    if settings.model is None:
        nothing = {"prompt": "string", "ml_label": "string", "ml_confidence": "double"}
        facts = facts.withColumns({name: F.lit(None).cast(kind) for name, kind in nothing.items()})
        return facts.drop("text", "content")
    # The prompt is made before scoring, so that nothing behind it asks for texts and contents.
    asked = facts.withColumns(
        {
            "_scored": F.when(classifiable, F.col("text")),
            "prompt": F.when(classifiable, second.prompt(F.col("text"))),
            "_classifiable": classifiable,
        }
    )
    scored = settings.model.score(asked.drop("text", "content"), "_scored")
    unsure = F.col("_classifiable") & ~is_confident(F.col("ml_confidence"), settings.threshold)
    return scored.withColumns(
        {
            "prompt": F.when(unsure, F.col("prompt")),
            "ml_label": F.when(F.col("_classifiable"), F.col("ml_label")),
            "ml_confidence": F.when(F.col("_classifiable"), F.col("ml_confidence")),
        }
    ).drop("probabilities", "_scored", "_classifiable")


def file_facts(files: DataFrame, settings: Settings) -> DataFrame:
    """Reduce each file to the narrow facts all later steps need; bytes and text end here.

    ``files`` has ``path, file_name, file_ext, length, md5, text`` (text null if unreadable) and
    ``arrival_seq`` or ``modificationTime``.  Classification depends on the text alone, so it
    runs in the same pass: scoring a few copies twice costs less than shuffling all texts to
    leave them out.
    """
    return with_checks(content_facts(files, settings), settings)


def with_checks(facts: DataFrame, settings: Settings) -> DataFrame:
    """What each single file adds: the size check and whether it may register its content."""
    may_register = registerable(
        F.col("readable"), F.col("file_ext"), F.col("length"), settings.model is not None
    )
    return facts.withColumns(
        {"check_status": check_file(F.col("length"))["status"], "registerable": may_register}
    )


def decide(facts: DataFrame, settings: Settings, registry: DataFrame | None = None) -> DataFrame:
    """Duplicates, second opinion and the columns of each outcome, from staged facts."""
    has_model = settings.model is not None
    marked = mark_duplicates(facts, registry).withColumn(
        "outcome",
        outcome(
            F.col("length"), F.col("is_duplicate"), F.col("readable"), F.col("file_ext"), has_model
        ),
    )
    classified = F.col("outcome") == "classified"
    asks = classified & F.col("prompt").isNotNull()
    answered = marked.withColumn(
        "_answer", second.ask(F.when(asks, F.col("prompt")), settings.responder)
    )
    non_document = F.col("outcome") == "non-document"
    labelled = (
        answered.withColumn(
            "document_type",
            F.when(asks, second.parse_answer(F.col("_answer")))
            .when(classified, F.col("ml_label"))
            .when(non_document, F.lit(fixed.UNKNOWN)),
        )
        .withColumn(
            "confidence",
            F.when(classified, reported_confidence(F.col("ml_confidence"))).when(
                non_document, F.lit(0.0)
            ),
        )
        .withColumn(
            "method",
            F.when(asks, F.lit(fixed.METHOD_FALLBACK))
            .when(classified, F.lit(fixed.METHOD_ML))
            .when(non_document, F.lit(fixed.METHOD_FILE_TYPE)),
        )
        .withColumn("registered", F.col("registerable") & ~F.col("is_duplicate"))
    )
    return with_outcome_columns(labelled, settings.routes)


def triage(
    files: DataFrame,
    settings: Settings,
    registry: DataFrame | None = None,
    occupied: DataFrame | None = None,
) -> DataFrame:
    """Results of a set of files with ``text``, one row per file (``RESULT_SCHEMA``).

    The files are scanned once.  Their facts are staged, then only narrow rows are shuffled: by
    fingerprint, and by destination and name.
    """
    return triage_facts(file_facts(files, settings), settings, registry, occupied)


def triage_facts(
    facts: DataFrame,
    settings: Settings,
    registry: Known,
    occupied: Known,
    taken: Callable[[DataFrame, int], DataFrame] | None = None,
) -> DataFrame:
    """Results from facts.  ``registry`` and ``occupied`` may be functions that return what is known of
    the contents and names of the rows they are given.  ``taken`` looks planned names up at the sink (``destination, final_name``
    of those it holds); rows that asked for one of them are named anew, until no planned name is."""
    if "arrival_seq" not in facts.columns:
        facts = arrival_order(stage(facts, "unordered-facts"))
    facts = stage(facts, "facts")
    if callable(registry):
        registry = registry(facts)
    decided = decide(facts, settings, registry).drop("prompt", "_answer", "ml_label", "ml_confidence")
    decided = stage(decided, "decisions")
    if callable(occupied):
        occupied = occupied(decided)
    named = assign_names(decided, occupied).select(*RESULT_SCHEMA.names)
    attempt = 0
    while taken is not None:
        named, attempt = stage(named, "named"), attempt + 1
        clashes = stage(taken(named, attempt).distinct(), "taken")
        # Only files that no run has put there clash, so this ends at once in most runs.
        if clashes.join(named, ["destination", "final_name"], "left_semi").isEmpty():
            break
        found = clashes.select("destination", F.col("final_name").alias("file_name"), F.lit(0).cast("long").alias("last"))
        if occupied is not None:
            found = found.unionByName(occupied.select("destination", "file_name", F.col("last").cast("long").alias("last")))
        occupied = found.groupBy("destination", "file_name").agg(F.max("last").alias("last"))
        named = assign_names(decided, occupied).select(*RESULT_SCHEMA.names)
    return named


def read_texts(files: DataFrame, parsers: Mapping[str, Parser] | None = None) -> DataFrame:
    """Name, fingerprint and text of files with ``path, length, content`` and maybe ``md5``."""
    return extract_text(_fingerprinted(files), parsers)


def _fingerprinted(files: DataFrame) -> DataFrame:
    named = with_names(files)
    return named if "md5" in named.columns else named.withColumn("md5", fingerprint(F.col("content")))


def triage_folder(
    spark: SparkSession,
    folder: str,
    settings: Settings,
    registry: Known = None,
    occupied: Known = None,
    listing: DataFrame | None = None,
    handled: DataFrame | None = None,
    taken: Callable[[DataFrame, int], DataFrame] | None = None,
) -> DataFrame:
    """Triage of every regular file directly in a folder; empty for an empty folder.

    Files listed in ``handled`` (``path, modificationTime, length``) are left out."""
    listed = list_folder(spark, folder) if listing is None else listing
    if handled is not None:
        listed = listed.join(handled, ["path", "modificationTime", "length"], "left_anti")
    files = read_folder(spark, folder, listed)
    once = settings.parse_contents_once
    if bool(settings.parsers) if once is None else once:
        facts = facts_per_content(files, settings)
    else:
        facts = file_facts(read_texts(files, settings.parsers), settings)
    return triage_facts(facts, settings, registry, occupied, taken)


def facts_per_content(files: DataFrame, settings: Settings) -> DataFrame:
    """The facts of ``path, modificationTime, length, content`` with each content parsed once.

    For parsers that cost more than reading.  A first pass fingerprints all files; then one file
    per content and type is read again by path, on the executors, and parsed and scored; all
    copies look the outcome up.  No bytes are shuffled.
    """
    named = _fingerprinted(files).drop("content")
    named = stage(named.withColumn("_content", F.concat("md5", "file_ext")), "fingerprints")
    contents = stage(
        named.filter("length > 0")
        .groupBy("_content")
        .agg(F.min(F.struct("path", "modificationTime", "length")).alias("first"), F.count("*").alias("copies")),
        "contents",
    )
    texts = extract_text(with_names(fetch(dealt(contents.select("first.*")))), settings.parsers)
    learned = content_facts(texts.select("path", "file_ext", "text"), settings).drop("file_ext")
    by_content = contents.select("_content", "copies", F.col("first.path").alias("path")).join(
        stage(learned, "content-facts"), "path"
    )
    facts = join_facts(named, by_content.drop("path"), "_content", "copies").drop("_content")
    return with_checks(facts.fillna(False, ["readable"]), settings)


def verified(results: DataFrame, listing: DataFrame) -> DataFrame:
    """Results with the status of classified files set by what arrived at the sink."""
    return verify_arrival(results, listing)
