"""Text extraction, fragments, events and labelled lines."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doctriage.functions.text import decode_text_file
from doctriage.operators import extraction, metrics, routing
from doctriage.queries.registry import (
    FILE_TYPES, FILES_SQL, files_view, pick, query, sql_ext, sql_list, sql_strip, table,
)
from doctriage.session import shared_folder
from doctriage.sources.events import parse_events
from doctriage.sources.samples import clean_samples, read_samples


@query(
    f"""
SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN {sql_strip('text')} END AS text FROM documents
"""
)
def decoded_texts(spark, folder) -> DataFrame:
    """Text files with Windows line ends; every fifth ends in a byte that is no UTF-8."""
    documents = table(spark, folder, "documents")
    content = F.concat(
        F.encode(F.replace("text", F.lit("\n"), F.lit("\r\n")), "UTF-8"),
        F.when(F.col("doc_id") % 5 != 0, F.lit(b"")).otherwise(F.lit(b"\xff")),
    )
    return documents.select("doc_id", decode_text_file(content).alias("text"))


def line_parsers():
    """Stand-ins for the format libraries: every line of the content is one piece."""

    def pieces(content: bytes):
        lines = content.decode("utf-8").split("\n")
        return [(0, order, "str", line) for order, line in enumerate(lines)]

    def whole(content: bytes):
        return [(0, 0, "str", content.decode("utf-8"))]

    parsers = {kind: pieces for kind in (".pdf", ".docx", ".xlsx", ".pptx")}
    return parsers | {kind: whole for kind in (".jpg", ".jpeg", ".png")}


@query(
    f"""
WITH {FILES_SQL}, pieces AS (
    SELECT *, string_split(content, chr(10)) AS lines FROM files_v
), joined AS (
    SELECT arrival_seq, file_ext,
           CASE WHEN file_ext IN ('.docx', '.pptx')
                THEN array_to_string(list_filter(lines, lambda x: {sql_strip('x')} <> ''), ' ')
                WHEN file_ext IN ('.pdf', '.xlsx')
                THEN array_to_string(list_filter(lines, lambda x: x <> ''), ' ')
                WHEN file_ext IN ('.txt', '.jpg', '.jpeg', '.png') THEN content END AS raw
    FROM pieces
), stripped AS (SELECT arrival_seq, file_ext, {sql_strip('raw')} AS raw FROM joined)
SELECT arrival_seq, file_ext, CASE WHEN length(raw) >= 10 THEN raw END AS text FROM stripped
"""
)
def extracted_texts(spark, folder) -> DataFrame:
    files = files_view(spark, folder).withColumn("content", F.encode("content", "UTF-8"))
    return extraction.extract_text(files, line_parsers()).select("arrival_seq", "file_ext", "text")


# Turns as fragments of one file per conversation: a turn is a unit, a line a fragment.  Lines
# shorter than 5 characters are marked as numbers or booleans so that cell rules apply to them.
ASSEMBLED_TYPES = (".pdf", ".docx", ".xlsx", ".pptx", ".png")


def conversation_fragments(spark, folder) -> DataFrame:
    turns = table(spark, folder, "conversations")
    lines = turns.select(
        "conv_id", F.col("turn").cast("int").alias("unit_ord"),
        F.posexplode(F.split("text", "\n", -1)).alias("frag_ord", "value"),
    )
    cells = turns.select(
        "conv_id", F.col("turn").cast("int").alias("unit_ord"), F.lit(1_000_000).alias("frag_ord"),
        (F.col("turn") % 2).cast("string").alias("value"),
    )
    return lines.withColumn("kind", F.lit("str")).unionByName(cells.withColumn("kind", F.lit("num")))


@query(
    f"""
WITH lines AS (
    SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS value,
           generate_subscripts(string_split(text, chr(10)), 1) AS ord, 'str' AS kind FROM conversations
    UNION ALL
    SELECT conv_id, turn, (turn % 2)::VARCHAR, 10000000, 'num' FROM conversations
), typed AS (SELECT *, unnest([{sql_list(ASSEMBLED_TYPES)}]) AS file_ext FROM lines),
kept AS (
    SELECT *, CASE WHEN file_ext IN ('.docx', '.pptx') THEN {sql_strip('value')} <> ''
                   WHEN file_ext = '.xlsx' THEN value <> '' AND NOT (kind = 'num' AND value = '0')
                   ELSE value <> '' END AS keep
    FROM typed
), joined AS (
    SELECT conv_id, file_ext, string_agg(value, ' ' ORDER BY turn, ord) FILTER (WHERE keep) AS text
    FROM kept GROUP BY conv_id, file_ext
)
SELECT conv_id, file_ext, {sql_strip("coalesce(text, '')")} AS text FROM joined
"""
)
def assembled_texts(spark, folder) -> DataFrame:
    fragments = conversation_fragments(spark, folder)
    typed = fragments.select("*", F.explode(F.array(*[F.lit(t) for t in ASSEMBLED_TYPES])).alias("file_ext"))
    return extraction.assemble_text(typed, ["conv_id", "file_ext"], F.col("file_ext"))


def conversation_blocks(spark, folder) -> DataFrame:
    """An OCR response per conversation: user turns are lines, the others words."""
    block = F.struct(
        "turn",
        F.when(F.col("role") == "user", "LINE").otherwise("WORD").alias("BlockType"),
        F.col("text").alias("Text"),
    )
    grouped = table(spark, folder, "conversations").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(block)).alias("blocks")
    )
    return grouped.withColumn(
        "blocks",
        F.transform(
            "blocks", lambda b: F.struct(b["BlockType"].alias("BlockType"), b["Text"].alias("Text"))
        ),
    )


LINES_SQL = f"""
line_texts AS (
    SELECT conv_id,
           {sql_strip("coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (WHERE role = 'user'), '')")} AS text
    FROM conversations GROUP BY conv_id
)"""


@query(f"WITH {LINES_SQL} SELECT * FROM line_texts")
def ocr_lines(spark, folder) -> DataFrame:
    return conversation_blocks(spark, folder).select(
        "conv_id", extraction.line_text(F.col("blocks")).alias("text")
    )


def stored_objects(spark, folder) -> DataFrame:
    """Conversations as stored objects of all types; the content is all their turns."""
    ext = pick(FILE_TYPES, F.col("conv_id") % len(FILE_TYPES))
    whole = F.array_join(F.transform("blocks", lambda block: block["Text"]), "\n")
    return conversation_blocks(spark, folder).select(
        F.lit("intake").alias("bucket"),
        F.concat(F.lit("in/c"), F.col("conv_id").cast("string"), ext).alias("key"),
        F.lower(ext).alias("file_ext"),
        F.encode(whole, "UTF-8").alias("content"),
        "blocks",
        "conv_id",
    )


OBJECTS_SQL = f"""
{LINES_SQL}, objects AS (
    SELECT c.conv_id, 'in/c' || c.conv_id || ([{sql_list(FILE_TYPES)}])[c.conv_id % {len(FILE_TYPES)} + 1] AS key,
           lower(([{sql_list(FILE_TYPES)}])[c.conv_id % {len(FILE_TYPES)} + 1]) AS file_ext,
           f.whole, c.text AS lines
    FROM line_texts c JOIN (
        SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS whole FROM conversations GROUP BY conv_id
    ) f USING (conv_id)
), object_texts AS (
    SELECT conv_id, key, file_ext,
           CASE WHEN file_ext = '.txt' THEN whole
                WHEN file_ext IN ('.pdf', '.jpg', '.jpeg', '.png') THEN lines END AS text
    FROM objects
)"""


@query(f"WITH {OBJECTS_SQL} SELECT key, file_ext, text FROM object_texts")
def object_texts(spark, folder) -> DataFrame:
    objects = stored_objects(spark, folder)
    text = extraction.cloud_text(F.col("file_ext"), F.col("content"), F.col("blocks"))
    return objects.select("key", "file_ext", text.alias("text"))


def storage_events(spark, folder) -> DataFrame:
    """Two records per page: its URL as a key, and a derived name holding '+' and '%20'."""
    url = F.replace("url", F.lit("http"), F.lit("a b+http"))
    encoded = F.replace(F.replace(url, F.lit("+"), F.lit("%2B")), F.lit(" "), F.lit("+"))

    def record(key):
        bucket = F.struct(F.lit("intake").alias("name"))
        return F.struct(F.struct(bucket.alias("bucket"), F.struct(key.alias("key")).alias("object")).alias("s3"))

    records = F.array(record(encoded), record(F.concat(F.lit("x/p%20"), F.col("page_id").cast("string"), F.lit("+A.TXT"))))
    return table(spark, folder, "pages").select(
        F.col("page_id").alias("event_id"), F.to_json(F.struct(records.alias("Records"))).alias("body")
    )


EVENTS_SQL = f"""
records AS (
    SELECT page_id AS event_id, 0 AS record_ord, replace(url, 'http', 'a b+http') AS key FROM pages
    UNION ALL SELECT page_id, 1, 'x/p ' || page_id || ' A.TXT' FROM pages
), parsed AS (
    SELECT event_id, record_ord, 'intake' AS bucket, key, regexp_extract(key, '[^/]*$') AS filename FROM records
)"""


@query(f"WITH {EVENTS_SQL} SELECT *, lower({sql_ext('filename')}) AS file_ext FROM parsed")
def object_events(spark, folder) -> DataFrame:
    return parse_events(storage_events(spark, folder))


@query(f"WITH {EVENTS_SQL} SELECT *, lower({sql_ext('filename')}) AS file_ext FROM parsed WHERE record_ord = 0")
def object_events_first_record(spark, folder) -> DataFrame:
    return parse_events(storage_events(spark, folder), first_record_only=True)


ROUTED_LABELS = ("Resume", "Invoice", "Paystub", "Contract", "Unknown", "Letter")


@query(
    f"""
WITH labelled AS (
    SELECT doc_id, ([{sql_list(ROUTED_LABELS)}])[doc_id % 6 + 1] AS document_type, source || '/' || lang || '.txt' AS key
    FROM documents
)
SELECT doc_id, document_type,
       CASE document_type WHEN 'Resume' THEN 'documents/hr/resumes' WHEN 'Invoice' THEN 'documents/finance/invoices'
            WHEN 'Paystub' THEN 'documents/finance/paystubs' WHEN 'Contract' THEN 'documents/legal/contracts'
            ELSE 'documents/unknown' END AS destination,
       CASE document_type WHEN 'Resume' THEN 'hr/resumes/' WHEN 'Invoice' THEN 'finance/invoices/'
            WHEN 'Paystub' THEN 'finance/paystubs/' WHEN 'Contract' THEN 'legal/contracts/'
            ELSE 'unknown/' END || regexp_extract(key, '[^/]*$') AS dest_key
FROM labelled
"""
)
def destinations(spark, folder) -> DataFrame:
    label, key = F.col("document_type"), F.concat("source", F.lit("/"), "lang", F.lit(".txt"))
    return (
        table(spark, folder, "documents")
        .withColumn("document_type", pick(ROUTED_LABELS, F.col("doc_id") % 6))
        .select(
            "doc_id", "document_type", routing.destination(label).alias("destination"),
            routing.destination_key(label, key).alias("dest_key"),
        )
    )


CORPUS_FILES = ("resumes.txt", "invoices.txt", "paystubs.txt", "contracts.txt")
CORPUS_SQL = f"""
lines AS (
    SELECT ([{sql_list(("Resume", "Invoice", "Paystub", "Contract"))}])[doc_id % 4 + 1] AS label,
           unnest(string_split(text, chr(10))) AS line
    FROM documents
), samples AS (
    SELECT label, {sql_strip('line')} AS text FROM lines WHERE length({sql_strip('line')}) > 20
)"""


def corpus_lines(spark, folder) -> DataFrame:
    """Every line of every document as a labelled line."""
    label = pick(("Resume", "Invoice", "Paystub", "Contract"), F.col("doc_id") % 4)
    return table(spark, folder, "documents").select(
        label.alias("label"), F.explode(F.split("text", "\n", -1)).alias("text")
    )


@query(f"WITH {CORPUS_SQL} SELECT label, text FROM samples")
def sample_lines(spark, folder) -> DataFrame:
    return clean_samples(corpus_lines(spark, folder))


@query(
    f"""
WITH {CORPUS_SQL}
SELECT coalesce(label, '(all)') AS label, count(*) AS samples FROM samples GROUP BY ROLLUP (label)
"""
)
def samples_per_label(spark, folder) -> DataFrame:
    return metrics.label_totals(clean_samples(corpus_lines(spark, folder)))


@query(f"WITH {CORPUS_SQL} SELECT label, text FROM samples")
def sample_files(spark, folder) -> DataFrame:
    """The labelled lines written as one text dataset per label and read back."""
    root = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    lines = corpus_lines(spark, folder)
    for name, label in zip(CORPUS_FILES, ("Resume", "Invoice", "Paystub", "Contract")):
        lines.filter(F.col("label") == label).select("text").write.text(f"{root}/{name}")
    return read_samples(spark, root)
