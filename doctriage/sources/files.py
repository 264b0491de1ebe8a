"""Folders of files."""

from __future__ import annotations

import io
import math
from functools import reduce
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doctriage.functions.paths import base_name, file_ext
from doctriage.session import stage
from doctriage.sources.store import open_store

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary, md5 string"
LISTING_CHUNK = 50_000
FETCH_BYTES = 16 * 1024 * 1024
# A row cannot hold a file of any size; above this only the fingerprint is taken.
CONTENT_BYTES = 1024 * 1024 * 1024
TASK_BYTES = 128 * 1024 * 1024
TASK_FILES = 20_000
PIECE_BYTES = 1024 * 1024


def read_folder(spark: SparkSession, folder: str, listing: DataFrame | None = None) -> DataFrame:
    """Every regular file directly in ``folder`` with its bytes, as ``fetch`` returns them.

    Empty files and names starting with ``_`` or ``.`` count too, which Spark's file source leaves
    out, so the files are read by a ``listing`` (``path, modificationTime, length``; for instance a
    storage inventory) or, without one, by a listing of the folder.  Only the narrow listing is
    ``dealt`` out.  Files gone meanwhile are left out.
    """
    listed = list_folder(spark, folder) if listing is None else listing
    return fetch(dealt(listed)).filter(F.col("length").isNotNull())


def dealt(files: DataFrame) -> DataFrame:
    """Deal rows that stand for files (``path`` and maybe ``length``) out for work on the files: about
    ``TASK_BYTES`` of content and ``TASK_FILES`` files a task at most, and equally many tasks for each core.

    A listing or a plan is narrow, so it comes in as few partitions as its own bytes ask for, often one.
    It is counted here, so pass stored rows.
    """
    size = F.sum("length") if "length" in files.columns else F.lit(None)
    count, size = files.agg(F.count("*"), size).first()
    cores = files.sparkSession.sparkContext.defaultParallelism
    rounds = math.ceil(max((size or 0) / TASK_BYTES, count / TASK_FILES, 1) / cores)
    return files.repartition(max(1, min(count, rounds * cores)), "path")


def read_fingerprints(listed: DataFrame) -> DataFrame:
    """``path, md5`` of the listed files, taken from their bytes, which stay in the tasks."""
    return fetch(dealt(listed), content_bytes=0).select("path", "md5")


def with_names(files: DataFrame) -> DataFrame:
    """Add ``file_name`` and ``file_ext``."""
    return files.withColumn("file_name", base_name(F.col("path"))).withColumn(
        "file_ext", file_ext(F.col("file_name"))
    )


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its scheme, as Spark's readers report it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()


def _entries(folder: str):
    """``path, millis, length, is_folder`` of what lies directly in a folder; nothing if it is gone.

    Links to files count as files; links to folders are not followed.
    """
    import os

    from pyarrow import fs

    store, inner = open_store(folder)
    base = folder.rstrip("/")
    if isinstance(store, fs.LocalFileSystem):
        try:
            found = os.scandir(inner)
        except (FileNotFoundError, NotADirectoryError):
            return
        with found:
            for entry in found:
                try:
                    if entry.is_dir(follow_symlinks=False):
                        yield f"{base}/{entry.name}", 0, 0, True
                    elif entry.is_file():
                        status = entry.stat()
                        yield f"{base}/{entry.name}", status.st_mtime_ns // 1_000_000, status.st_size, False
                except FileNotFoundError:
                    continue
        return
    for info in store.get_file_info(fs.FileSelector(inner, allow_not_found=True)):
        if info.type == fs.FileType.Directory:
            yield f"{base}/{info.base_name}", 0, 0, True
        elif info.type == fs.FileType.File:
            yield f"{base}/{info.base_name}", (info.mtime_ns or 0) // 1_000_000, info.size, False


ENTRIES = "path string, millis long, length long, is_folder boolean"


def list_folders(folders: DataFrame) -> DataFrame:
    """The entries directly in each of ``folders`` (``path``), listed by the tasks."""

    def run(batches):
        for batch in batches:
            for folder in batch["path"]:
                entries = _entries(folder)
                while chunk := list(islice(entries, LISTING_CHUNK)):
                    yield pd.DataFrame(chunk, columns=["path", "millis", "length", "is_folder"])

    return folders.select("path").mapInPandas(run, ENTRIES)


def list_folder(spark: SparkSession, folder: str, below: bool = False) -> DataFrame:
    """Regular files directly in ``folder`` (or anywhere ``below`` it), hidden and empty ones
    included; none if there is no such folder.

    Folders are rows: one round lists all folders of one depth, each by a task, and the folders it
    finds are the next round's.  No name passes through the driver; each round is a written table, so
    the listing does not change while it is used.
    """
    frontier = spark.range(0, 1, 1, 1).select(F.lit(qualified(spark, folder)).alias("path"))
    levels = [stage(list_folders(frontier), "listing")]
    while below:
        frontier = levels[-1].filter("is_folder")
        if frontier.isEmpty():
            break
        levels.append(stage(list_folders(frontier.repartition("path")), "listing"))
    found = reduce(DataFrame.unionByName, levels).filter("NOT is_folder")
    return found.select("path", F.timestamp_millis("millis").alias("modificationTime"), "length")


def fetch(
    listed: DataFrame, chunk_bytes: int = FETCH_BYTES, content_bytes: int = CONTENT_BYTES
) -> DataFrame:
    """Read the listed files on the executors, by path; a file gone meanwhile has null length.

    Files are handed on in chunks of about ``chunk_bytes``, so a task holds few contents at once.
    A file above ``content_bytes`` has null content: it is fingerprinted piece by piece, counts as
    unreadable where its type could be read, and is copied like any other.
    """

    def load(path):
        import hashlib

        try:
            store, inner = open_store(path)
            with store.open_input_stream(inner) as stream:
                # Read in pieces: a read makes room for all it asks for, however small the file is.
                digest, size, kept = hashlib.md5(), 0, io.BytesIO()
                while piece := stream.read(PIECE_BYTES):
                    digest.update(piece)
                    size += len(piece)
                    if size > content_bytes:
                        kept = None
                    else:
                        kept.write(piece)
                return size, None if kept is None else kept.getvalue(), digest.hexdigest()
        except FileNotFoundError:
            return None, None, None

    def read(batches):
        for batch in batches:
            rows, held = [], 0
            for path, moment in zip(batch["path"], batch["modificationTime"]):
                size, content, digest = load(path)
                rows.append((path, moment, size, content, digest))
                held += len(content or b"")
                if held >= chunk_bytes:
                    yield frame(rows)
                    rows, held = [], 0
            if rows:
                yield frame(rows)

    def frame(rows):
        made = pd.DataFrame(rows, columns=["path", "modificationTime", "length", "content", "md5"])
        return made.astype({"length": "Int64"})

    return listed.select("path", "modificationTime").mapInPandas(read, FILE_SCHEMA)


def arrival_order(files: DataFrame) -> DataFrame:
    """Add ``arrival_seq`` by modification time and path.

    A range-partitioned sort followed by order-preserving ids.  Pass narrow rows without content,
    and stage the result before using it twice, since the ids depend on the partitioning.
    """
    return files.orderBy("modificationTime", "path").withColumn(
        "arrival_seq", F.monotonically_increasing_id()
    )
