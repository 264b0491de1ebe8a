"""Where queries and their SQL are collected, and the views they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doctriage.functions.paths import file_ext, is_supported
from doctriage.functions.text import is_long_enough, py_strip

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the function under its own name, with its SQL if there is one."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql.strip()
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# The documents as a folder of files: names repeat, types vary, and every document labelled toxic
# comes with an empty file of the same name.  The text stands for the parsed content.
FILE_TYPES = (".txt", ".pdf", ".docx", ".jpg", ".jpeg", ".png", ".xlsx", ".pptx", ".mp4", ".TXT")
FILE_NAMES = 37


def pick(values: tuple[str, ...], position: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), position.cast("int"))


def files_view(spark: SparkSession, folder: str) -> DataFrame:
    """``arrival_seq, path, file_name, file_ext, length, md5, content``."""
    columns = ["doc_id", "content", "arrival_seq"]
    documents = table(spark, folder, "documents").select(
        "doc_id", F.col("text").alias("content"), (F.col("doc_id") * 2).alias("arrival_seq")
    )
    empties = (
        table(spark, folder, "labels")
        .filter("toxic = 1")
        .select("doc_id", F.lit("").alias("content"), (F.col("doc_id") * 2 + 1).alias("arrival_seq"))
    )
    name = F.concat(
        F.lit("f"),
        (F.col("doc_id") % FILE_NAMES).cast("string"),
        pick(FILE_TYPES, F.col("doc_id") % len(FILE_TYPES)),
    )
    return (
        documents.select(*columns)
        .unionByName(empties)
        .withColumn("file_name", name)
        .withColumn("file_ext", file_ext(F.col("file_name")))
        .withColumn("path", F.concat(F.lit("uploads/"), F.col("file_name")))
        .withColumn("length", F.octet_length("content").cast("long"))
        .withColumn("md5", F.md5("content"))
        .drop("doc_id")
    )


def files_with_text(spark: SparkSession, folder: str) -> DataFrame:
    """Files with ``text``: the stripped content where type and length make it readable."""
    files = files_view(spark, folder).withColumn("_stripped", py_strip(F.col("content")))
    readable = is_supported(F.col("file_ext")) & is_long_enough(F.col("_stripped"))
    return files.withColumn("text", F.when(readable, F.col("_stripped"))).drop("_stripped")


# ---- SQL building blocks ----------------------------------------------------------------


def sql_strip(value: str) -> str:
    blank = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"
    return f"regexp_replace({value}, '^{blank}|{blank}$', '', 'g')"


def sql_round(value: str, digits: int) -> str:
    """Half-even on the exact binary value, which is how printf prints a double."""
    return f"CAST(printf('%.{digits}f', {value}) AS DOUBLE)"


def sql_ext(name: str) -> str:
    bare = f"ltrim({name}, '.')"
    return f"(CASE WHEN strpos({bare}, '.') > 0 THEN regexp_extract({name}, '\\.[^.]*$') ELSE '' END)"


def sql_list(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


SUPPORTED = sql_list((".pdf", ".docx", ".jpg", ".jpeg", ".png", ".txt", ".xlsx", ".pptx"))

FILES_SQL = f"""
raw_files AS (
    SELECT doc_id, text AS content, doc_id * 2 AS arrival_seq FROM documents
    UNION ALL
    SELECT doc_id, '' AS content, doc_id * 2 + 1 AS arrival_seq FROM labels WHERE toxic = 1
), named_files AS (
    SELECT *, 'f' || (doc_id % {FILE_NAMES})::VARCHAR
           || ([{sql_list(FILE_TYPES)}])[doc_id % {len(FILE_TYPES)} + 1] AS file_name
    FROM raw_files
), files_v AS (
    SELECT doc_id, arrival_seq, file_name, lower({sql_ext('file_name')}) AS file_ext,
           'uploads/' || file_name AS path, CAST(strlen(content) AS BIGINT) AS length,
           md5(content) AS md5, content, {sql_strip('content')} AS stripped
    FROM named_files
), facts AS (
    SELECT *, file_ext IN ({SUPPORTED}) AND length(stripped) >= 10 AS readable
    FROM files_v
)"""
