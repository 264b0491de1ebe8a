"""Files: checks, types, fingerprints, duplicates, names."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doctriage import fixed
from doctriage.functions import numbers, paths, times
from doctriage.functions.paths import base_name
from doctriage.functions.text import char_count, is_readable, preview, py_strip
from doctriage.operators import duplicates, extraction, naming, routing
from doctriage.operators.validation import check_file, is_non_document
from doctriage.plans import local, runs
from doctriage.queries.registry import (
    FILES_SQL, SUPPORTED, files_view, files_with_text, pick, query, sql_ext, sql_list, sql_round, sql_strip, table,
)
from doctriage.session import shared_folder, stage
from doctriage.sources.files import list_folder, read_fingerprints, read_folder, with_names
from doctriage.sources.store import open_store

# The given texts are far below 50 MiB, so the query lowers the limit to reach the warning.
LARGE = 4096


@query(
    f"""
WITH {FILES_SQL}
SELECT arrival_seq, file_name,
       CASE WHEN length = 0 THEN 'rejected' WHEN length > {LARGE} THEN 'warning' ELSE 'ok' END AS status,
       CASE WHEN length = 0 THEN 'File is completely empty (0 bytes)'
            WHEN length > {LARGE} THEN 'File is large (over 50MB) - processing may take longer'
            ELSE 'File is valid' END AS reason,
       {sql_round('length / 1024.0::DOUBLE', 2)} AS size_kb
FROM files_v
"""
)
def validate_files(spark, folder) -> DataFrame:
    return files_view(spark, folder).select(
        "arrival_seq", "file_name", F.inline(F.array(check_file(F.col("length"), LARGE))),
        numbers.size_kb(F.col("length")).alias("size_kb"),
    )


@query(
    """
WITH listing AS (SELECT doc_id FROM documents),
sizes AS (SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS length FROM documents
          WHERE doc_id IN (SELECT doc_id FROM labels))
SELECT doc_id,
       CASE WHEN s.length IS NULL THEN 'rejected' ELSE 'ok' END AS status,
       CASE WHEN s.length IS NULL THEN 'File does not exist' ELSE 'File is valid' END AS reason
FROM listing LEFT JOIN sizes s USING (doc_id)
"""
)
def missing_files(spark, folder) -> DataFrame:
    """A manifest of all documents, of which only the labelled ones are present."""
    documents = table(spark, folder, "documents")
    sizes = documents.join(table(spark, folder, "labels"), "doc_id", "left_semi").select(
        "doc_id", F.octet_length("text").alias("length")
    )
    return (
        documents.select("doc_id")
        .join(sizes, "doc_id", "left")
        .select("doc_id", F.inline(F.array(check_file(F.col("length")))))
    )


@query(
    f"""
WITH names AS (
    SELECT 'page' || page_id AS id, url AS path FROM pages
    UNION ALL SELECT 'doc' || doc_id, source || '/.' || lang || '.' || source FROM documents
), parts AS (SELECT id, path, regexp_extract(path, '[^/]*$') AS file_name FROM names)
SELECT id, file_name, {sql_ext('file_name')} AS raw_ext, lower({sql_ext('file_name')}) AS file_ext,
       left(file_name, length(file_name) - length({sql_ext('file_name')})) AS stem,
       lower({sql_ext('file_name')}) IN ({SUPPORTED}) AS supported
FROM parts
"""
)
def file_types(spark, folder) -> DataFrame:
    pages = table(spark, folder, "pages").select(
        F.concat(F.lit("page"), F.col("page_id").cast("string")).alias("id"), F.col("url").alias("path")
    )
    documents = table(spark, folder, "documents").select(
        F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("id"),
        F.concat("source", F.lit("/."), "lang", F.lit("."), "source").alias("path"),
    )
    name = F.col("file_name")
    return pages.unionByName(documents).select("id", paths.base_name(F.col("path")).alias("file_name")).select(
        "id", "file_name", paths.raw_ext(name).alias("raw_ext"), paths.file_ext(name).alias("file_ext"),
        paths.stem(name).alias("stem"), paths.is_supported(paths.file_ext(name)).alias("supported"),
    )


@query(f"WITH {FILES_SQL} SELECT arrival_seq, file_name, md5(content) AS md5 FROM files_v")
def fingerprints(spark, folder) -> DataFrame:
    return files_view(spark, folder).select(
        "arrival_seq", "file_name", duplicates.fingerprint(F.col("content")).alias("md5")
    )


REGISTERABLE_SQL = "length > 0 AND readable"
DUPLICATES_SQL = f"""
first_seen AS (
    SELECT md5, min(arrival_seq) FILTER (WHERE {REGISTERABLE_SQL}) AS first_registered
    FROM facts GROUP BY md5
), marked AS (
    SELECT f.*, length > 0 AND coalesce(arrival_seq > first_registered, FALSE) AS is_duplicate
    FROM facts f JOIN first_seen USING (md5)
)"""


def duplicate_input(spark, folder) -> DataFrame:
    """The narrow rows the duplicate test needs, written once so that the texts are read once."""
    readable = F.col("text").isNotNull()
    registers = routing.registerable(readable, F.col("file_ext"), F.col("length"), True)
    files = files_with_text(spark, folder)
    return stage(files.select("arrival_seq", "md5", "length", registers.alias("registerable")), "fingerprints")


@query(f"WITH {FILES_SQL}, {DUPLICATES_SQL} SELECT arrival_seq, md5, is_duplicate FROM marked")
def ordered_duplicates(spark, folder) -> DataFrame:
    marked = duplicates.mark_duplicates(duplicate_input(spark, folder))
    return marked.select("arrival_seq", "md5", "is_duplicate")


def past_registry(spark, folder) -> DataFrame:
    """Contents registered by an earlier run: those of the documents labelled as good."""
    good = table(spark, folder, "labels").filter("quality = 1")
    documents = table(spark, folder, "documents").join(good, "doc_id", "left_semi")
    return documents.select(F.md5("text").alias("md5"))


REGISTRY_SQL = """
registry AS (
    SELECT DISTINCT md5(text) AS md5 FROM documents
    WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)
)"""


@query(
    f"""
WITH {FILES_SQL}, {DUPLICATES_SQL}, {REGISTRY_SQL}
SELECT arrival_seq, md5,
       is_duplicate OR (length > 0 AND md5 IN (SELECT md5 FROM registry)) AS is_duplicate
FROM marked
"""
)
def duplicates_with_registry(spark, folder) -> DataFrame:
    marked = duplicates.mark_duplicates(duplicate_input(spark, folder), past_registry(spark, folder))
    return marked.select("arrival_seq", "md5", "is_duplicate")


@query(
    f"""
WITH {FILES_SQL}, {REGISTRY_SQL}
SELECT arrival_seq, file_name, md5 IN (SELECT md5 FROM registry) AS seen FROM files_v
"""
)
def seen_contents(spark, folder) -> DataFrame:
    files = files_view(spark, folder).select("arrival_seq", "file_name", "md5")
    registry = past_registry(spark, folder)
    seen = duplicates.seen_before(files, registry).withColumn("seen", F.lit(True))
    new = duplicates.not_seen_before(files, registry).withColumn("seen", F.lit(False))
    return seen.unionByName(new).drop("md5")


@query(
    f"""
WITH {FILES_SQL}, {REGISTRY_SQL}
SELECT md5 FROM registry UNION SELECT md5 FROM facts WHERE {REGISTERABLE_SQL}
"""
)
def registry_after_run(spark, folder) -> DataFrame:
    results = duplicate_input(spark, folder).withColumnRenamed("registerable", "registered")
    return duplicates.add_to_registry(past_registry(spark, folder), results)


TEXTS_SQL = """
texts AS (
    SELECT 'document' AS kind, doc_id AS id, CAST(0 AS BIGINT) AS part, text FROM documents
    UNION ALL SELECT 'turn', conv_id, turn, text FROM conversations
)"""


def all_texts(spark, folder) -> DataFrame:
    documents = table(spark, folder, "documents").select(
        F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("part"), "text"
    )
    turns = table(spark, folder, "conversations").select(
        F.lit("turn").alias("kind"), F.col("conv_id").alias("id"), F.col("turn").alias("part"), "text"
    )
    return documents.unionByName(turns)


@query(
    f"""
WITH {TEXTS_SQL}
SELECT kind, id, part, length(text) AS chars, length({sql_strip('text')}) AS stripped_chars,
       length({sql_strip('text')}) >= 10 AS readable, left(text, 300) AS preview
FROM texts
"""
)
def readable_texts(spark, folder) -> DataFrame:
    text = F.col("text")
    return all_texts(spark, folder).select(
        "kind", "id", "part",
        char_count(text).cast("long").alias("chars"),
        char_count(py_strip(text)).cast("long").alias("stripped_chars"),
        is_readable(text).alias("readable"),
        preview(text).alias("preview"),
    )


@query(
    f"""
WITH {FILES_SQL}
SELECT arrival_seq, file_ext,
       CASE WHEN file_ext IN ({SUPPORTED}) THEN 'unreadable' ELSE 'unsupported' END AS status,
       CASE WHEN file_ext IN ({SUPPORTED}) THEN 'Unreadable' ELSE 'Unsupported' END AS shown
FROM facts WHERE NOT readable
"""
)
def failed_reads(spark, folder) -> DataFrame:
    failed = files_with_text(spark, folder).filter("text IS NULL")
    status = extraction.failure_status(F.col("file_ext"))
    return failed.select(
        "arrival_seq", "file_ext", status.alias("status"), F.initcap(status).alias("shown")
    )


@query(f"WITH {FILES_SQL} SELECT arrival_seq, file_ext IN ('.pptx', '.xlsx') AS non_document FROM facts WHERE readable")
def non_documents(spark, folder) -> DataFrame:
    readable = files_with_text(spark, folder).filter("text IS NOT NULL")
    return readable.select("arrival_seq", is_non_document(F.col("file_ext")).alias("non_document"))


@query(
    f"""
WITH {FILES_SQL}, placed AS (
    SELECT arrival_seq, file_name, CASE WHEN readable THEN 'documents/unknown' ELSE 'documents/miscellaneous/unreadable' END AS destination
    FROM facts
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY destination, file_name ORDER BY arrival_seq) - 1 AS n FROM placed
)
SELECT arrival_seq, destination,
       CASE WHEN n = 0 THEN file_name
            ELSE left(file_name, length(file_name) - length({sql_ext('file_name')})) || '_' || n || {sql_ext('file_name')}
       END AS final_name
FROM ranked
"""
)
def free_names(spark, folder) -> DataFrame:
    readable = F.col("text").isNotNull()
    placed = files_with_text(spark, folder).select(
        "arrival_seq", "file_name",
        F.when(readable, fixed.DEFAULT_ROUTE).otherwise(fixed.UNREADABLE_FOLDER).alias("destination"),
    )
    named = naming.assign_names(stage(placed, "placed"))
    return named.select("arrival_seq", "destination", "final_name")


@query(
    """
WITH RECURSIVE requests AS (
    SELECT doc_id AS arrival_seq, source || '/' || lang AS destination,
           'scan' || CASE WHEN doc_id % 5 > 0 THEN '_' || (doc_id % 5) ELSE '' END AS base,
           row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS n
    FROM documents
), walk AS (
    SELECT DISTINCT destination, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS arrival_seq, CAST(NULL AS VARCHAR) AS base,
           CAST(0 AS BIGINT) AS number, ['scan_2'] AS taken
    FROM requests
    UNION ALL
    SELECT destination, n, arrival_seq, base, number,
           list_append(taken, base || CASE WHEN number > 0 THEN '_' || number ELSE '' END)
    FROM (
        SELECT w.destination, r.n, r.arrival_seq, r.base, w.taken,
               list_filter(range(0, len(w.taken) + 1), lambda i:
                   NOT list_contains(w.taken, r.base || CASE WHEN i > 0 THEN '_' || i ELSE '' END))[1] AS number
        FROM walk w JOIN requests r ON r.destination = w.destination AND r.n = w.n + 1
    )
)
SELECT arrival_seq, destination, base || '.pdf' AS file_name,
       base || CASE WHEN number > 0 THEN '_' || number ELSE '' END || '.pdf' AS final_name, number AS name_number
FROM walk WHERE n > 0
"""
)
def free_names_numbered(spark, folder) -> DataFrame:
    """Requested names that look numbered themselves, against existing names: first-free numbering
    then depends on the order of all earlier names."""
    documents = table(spark, folder, "documents").select("doc_id", "source", "lang")
    number = F.col("doc_id") % 5
    name = F.concat(
        F.lit("scan"), F.when(number > 0, F.concat(F.lit("_"), number.cast("string"))).otherwise(""), F.lit(".pdf")
    )
    requests = documents.select(
        F.col("doc_id").alias("arrival_seq"), F.concat_ws("/", "source", "lang").alias("destination"), name.alias("file_name")
    )
    existing = requests.select("destination", F.lit("scan_2.pdf").alias("file_name")).distinct()
    return naming.assign_names(stage(requests, "placed"), existing)


@query(
    f"""
SELECT event_id, {sql_round('value', 1)} AS one, {sql_round('value / 7', 2)} AS two,
       printf('%.1f', value) AS shown, strftime(ts, '%Y-%m-%d %H:%M:%S') AS logged,
       strftime(ts, '%H:%M:%S') AS clock
FROM events
"""
)
def rounding_and_times(spark, folder) -> DataFrame:
    value, moment = F.col("value"), F.col("ts")
    return table(spark, folder, "events").select(
        "event_id",
        numbers.round_half_even(value, 1).alias("one"),
        numbers.round_half_even(value / 7, 2).alias("two"),
        numbers.fixed_point(value, 1).alias("shown"),
        times.log_time(moment).alias("logged"),
        times.clock_time(moment).alias("clock"),
    )


@query(
    f"""
WITH spans AS (SELECT user_id, min(ts) AS started, max(ts) AS finished FROM events GROUP BY user_id)
SELECT user_id, {sql_round("(epoch_us(finished) - epoch_us(started)) / 1e6::DOUBLE", 2)} AS seconds FROM spans
"""
)
def elapsed_times(spark, folder) -> DataFrame:
    spans = table(spark, folder, "events").groupBy("user_id").agg(
        F.min("ts").cast("timestamp").alias("started"), F.max("ts").cast("timestamp").alias("finished")
    )
    return spans.select(
        "user_id", times.elapsed_seconds(F.col("started"), F.col("finished")).alias("seconds")
    )


# The documents as real files, under names that need care.  Types without a parser and without a
# model leave the outcome to name and length, so it does not depend on the order of arrival.
CARE = ("a b", "c%20d", "e#f", "ü", "_g", ".h", "i+j", "k&l=m")
CARE_TYPES = (".mp4", ".pdf", ".txt", "", ".JPG")

EXPORTED_SQL = f"""
exported AS (
    SELECT ([{sql_list(CARE)}])[doc_id % {len(CARE)} + 1] || ' ' || doc_id
           || ([{sql_list(CARE_TYPES)}])[doc_id % {len(CARE_TYPES)} + 1] AS file_name,
           CASE WHEN doc_id % 11 = 0 THEN '' ELSE text END AS content
    FROM documents
), scanned AS (
    SELECT file_name, lower({sql_ext('file_name')}) AS file_ext, CAST(strlen(content) AS BIGINT) AS length,
           md5(content) AS md5, {sql_strip('content')} AS stripped
    FROM exported
)"""


def exported(spark, folder, place: str | None = None, chosen=None) -> str:
    """Write every (or every ``chosen``) document as a file of its own, on the executors; returns the
    folder."""
    place = place or f"{shared_folder(spark)}/exports/{uuid.uuid4().hex}"
    number = F.col("doc_id")
    name = F.concat(
        pick(CARE, number % len(CARE)), F.lit(" "), number.cast("string"),
        pick(CARE_TYPES, number % len(CARE_TYPES)),
    )
    rows = table(spark, folder, "documents")
    files = (rows if chosen is None else rows.filter(chosen)).select(
        name.alias("name"), F.when(number % 11 == 0, "").otherwise(F.col("text")).alias("content")
    )

    def write(batches):
        store, base = open_store(place)
        # A folder of its own for each task: in one the tasks would wait for each other at every name.
        own = f"{base}-parts/{uuid.uuid4().hex}"
        for folder in (base, own):
            store.create_dir(folder, recursive=True)
        for batch in batches:
            for file_name, content in zip(batch["name"], batch["content"]):
                # A file appears with all its bytes, as a watcher may be looking.
                with store.open_output_stream(f"{own}/{file_name}") as stream:
                    stream.write((content or "").encode("utf-8"))
                store.move(f"{own}/{file_name}", f"{base}/{file_name}")
            yield batch[["name"]]

    files.mapInPandas(write, "name string").write.format("noop").mode("overwrite").save()
    return place


@query(f"WITH {EXPORTED_SQL} SELECT file_name, file_ext, length, md5 FROM scanned")
def folder_scan(spark, folder) -> DataFrame:
    """Every exported file, empty and hidden ones included, with its fingerprint."""
    files = with_names(read_folder(spark, exported(spark, folder)))
    return files.select("file_name", "file_ext", "length", "md5")


SORTED_SQL = f"""
WITH {EXPORTED_SQL}, outcomes AS (
    SELECT *, CASE WHEN length = 0 THEN 'rejected'
                   WHEN file_ext NOT IN ({SUPPORTED}) THEN 'unsupported'
                   WHEN file_ext <> '.txt' OR length(stripped) < 10 THEN 'unreadable'
                   ELSE 'error' END AS outcome
    FROM scanned
), placed AS (
    SELECT *, CASE outcome WHEN 'unsupported' THEN '{fixed.UNSUPPORTED_FOLDER}'
                           WHEN 'error' THEN NULL ELSE '{fixed.UNREADABLE_FOLDER}' END AS destination
    FROM outcomes
)
SELECT file_name, outcome, outcome AS status, destination,
       CASE WHEN destination IS NOT NULL THEN file_name END AS final_name,
       CASE WHEN destination IS NOT NULL THEN md5 END AS sink_md5"""


@query(f"{SORTED_SQL}, CAST(0 AS BIGINT) AS handled_again FROM placed")
def folder_run(spark, folder) -> DataFrame:
    """The exported files sorted: triage, copy, verify, log; then once more, which handles none.

    ``sink_md5`` is taken from the bytes at the destination.
    """
    root = f"{shared_folder(spark)}/runs/{uuid.uuid4().hex}"
    uploads = exported(spark, folder)
    done = runs.run_folder(spark, uploads, root, local.Settings())
    again = runs.run_folder(spark, uploads, root, local.Settings()).count()
    listed = list_folder(spark, f"{root}/documents", below=True)
    sunk = read_fingerprints(listed)
    sunk = sunk.select(base_name(F.col("path")).alias("final_name"), F.col("md5").alias("sink_md5"))
    return done.join(sunk, "final_name", "left").select(
        "file_name", "outcome", "status", "destination", "final_name", "sink_md5",
        F.lit(again).cast("long").alias("handled_again"),
    )


@query(f"{SORTED_SQL} FROM placed")
def watched_folder(spark, folder) -> DataFrame:
    """Half of the files lie there when the watcher starts, the others come while it runs."""
    root, uploads = (f"{shared_folder(spark)}/{name}/{uuid.uuid4().hex}" for name in ("runs", "exports"))
    exported(spark, folder, uploads, F.col("doc_id") % 2 == 0)
    watcher = runs.watch(spark, uploads, root, local.Settings(), every="1 second")
    # Rows of one doc_id are one file, which may be handled more than once if it is written again.
    wanted = table(spark, folder, "documents").agg(F.count_distinct("doc_id")).first()[0]

    def whole(found: DataFrame) -> bool:
        return found.count() >= wanted and found.select("path").distinct().count() >= wanted

    try:
        # What waits here is the query, not the watcher.
        while watcher.isActive and not runs.results(spark, root).count():
            time.sleep(0.5)
        exported(spark, folder, uploads, F.col("doc_id") % 2 == 1)
        while watcher.isActive and not whole(runs.results(spark, root)):
            time.sleep(0.5)
    finally:
        watcher.stop()
    sunk = read_fingerprints(list_folder(spark, f"{root}/documents", below=True))
    sunk = sunk.select(base_name(F.col("path")).alias("final_name"), F.col("md5").alias("sink_md5"))
    return runs.results(spark, root).join(sunk, "final_name", "left").select(
        "file_name", "outcome", "status", "destination", "final_name", "sink_md5"
    )
