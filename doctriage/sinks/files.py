"""Routed files and objects."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doctriage.operators.routing import destination_key
from doctriage.session import stage
from doctriage.sinks.logs import latest_per_key
from doctriage.sources.files import dealt, list_folder, list_folders, qualified
from doctriage.sources.store import open_store

MANIFEST_SCHEMA = "path string, destination string, final_name string, copied boolean"


def copy_files(plan: DataFrame, root: str, parts: str | None = None) -> DataFrame:
    """Copy each planned file to ``root/destination/final_name`` and report what was copied.

    ``plan`` has ``path, destination, final_name``.  Executors stream the bytes from store to
    store, so no content passes through a shuffle.  Nothing at the target is replaced: a file with
    the same bytes counts as copied, which makes a repeated task harmless, and any other file leaves
    the row uncopied.  Bytes are written to the folder ``parts`` (on the store of ``root``) and then
    moved, so a file that is there is whole; what a killed task leaves goes with that folder.  Each
    task has a folder of its own in it: in one folder the tasks would wait for each other at every
    name.  What cannot be read or written fails its row, not the run.  The plan is ``dealt`` out by the
    files behind it, so pass a stored one.
    """
    parts = parts or f"{root}/parts"

    def copy(batches):
        from pyarrow import fs

        sink, base = open_store(root)
        _, spare = open_store(f"{parts}/{uuid.uuid4().hex}")
        made = set()

        def same(source, inner, target):
            with source.open_input_stream(inner) as left, sink.open_input_stream(target) as right:
                while True:
                    own, other = left.read(1 << 20), right.read(1 << 20)
                    if own != other:
                        return False
                    if not own:
                        return True

        def one(path, folder, name):
            target = f"{base}/{folder}/{name}"
            try:
                source, inner = open_store(path)
                for place in (spare, f"{base}/{folder}"):
                    if place not in made:
                        sink.create_dir(place, recursive=True)
                        made.add(place)
                if sink.get_file_info(target).type != fs.FileType.NotFound:
                    return same(source, inner, target)
                _write(source, inner, sink, spare, target)
                return True
            except (OSError, ValueError):
                return False

        for batch in batches:
            rows = zip(batch["path"], batch["destination"], batch["final_name"])
            done = [one(*row) for row in rows]
            yield pd.DataFrame(
                {
                    "path": batch["path"],
                    "destination": batch["destination"],
                    "final_name": batch["final_name"],
                    "copied": done,
                }
            )

    moved = dealt(plan.filter(F.col("destination").isNotNull()))
    return moved.select("path", "destination", "final_name").mapInPandas(copy, MANIFEST_SCHEMA)


def _write(source, inner: str, sink, spare: str, target: str) -> None:
    """Stream a file into the folder ``spare`` and move it to ``target``; nothing stays if it fails."""
    import shutil

    partial = f"{spare}/{uuid.uuid4().hex}"
    try:
        with source.open_input_stream(inner) as reader:
            with sink.open_output_stream(partial) as writer:
                shutil.copyfileobj(reader, writer, 1 << 20)
        sink.move(partial, target)
    except OSError:
        try:
            sink.delete_file(partial)
        except OSError:
            pass
        raise


def held_files(plan: DataFrame, root: str) -> DataFrame:
    """``destination, final_name, length`` of the planned files that ``root`` holds.

    Each planned name is looked up by a task, so the cost follows the plan and not the sink.
    """

    def look(batches):
        from pyarrow import fs

        sink, base = open_store(root)
        for batch in batches:
            targets = [f"{base}/{folder}/{name}" for folder, name in zip(batch["destination"], batch["final_name"])]
            found = sink.get_file_info(targets) if targets else []
            there = [info.type != fs.FileType.NotFound for info in found]
            lengths = [info.size if info.type == fs.FileType.File else None for info in found]
            frame = pd.DataFrame({"destination": batch["destination"], "final_name": batch["final_name"]})
            yield frame.assign(length=pd.array(lengths, "Int64"))[there]

    moved = plan.filter(F.col("destination").isNotNull()).select("destination", "final_name")
    return moved.mapInPandas(look, "destination string, final_name string, length long")


def copy_objects(plan: DataFrame, root: str, parts: str | None = None) -> DataFrame:
    """Copy ``path`` to ``root/dest_key``; returns ``seq, copied`` for each row of ``plan``.

    Later rows (by ``seq``) replace earlier ones of the same key, so only the last is copied, and the
    others count as copied with it.  The step may be repeated while the sources are there.
    """
    parts = parts or f"{root}/parts"

    def copy(batches):
        sink, base = open_store(root)
        _, spare = open_store(parts)
        sink.create_dir(spare, recursive=True)
        for batch in batches:
            done = []
            for path, key in zip(batch["path"], batch["dest_key"]):
                target = f"{base}/{key}"
                try:
                    source, inner = open_store(path)
                    sink.create_dir(target.rpartition("/")[0], recursive=True)
                    _write(source, inner, sink, spare, target)
                    done.append(True)
                except OSError:
                    done.append(False)
            yield pd.DataFrame({"dest_key": batch["dest_key"], "copied": done})

    last = latest_per_key(plan.select("dest_key", "path", "seq"), "dest_key", "seq")
    there = stage(last.mapInPandas(copy, "dest_key string, copied boolean"), "copied")
    return plan.join(there, "dest_key").select("seq", "copied")


def remove_objects(plan: DataFrame) -> DataFrame:
    """Remove the sources ``path`` of ``plan``; returns ``path, removed``.  May be repeated: what is
    gone already counts as removed."""

    def remove(batches):
        for batch in batches:
            done = []
            for path in batch["path"]:
                try:
                    source, inner = open_store(path)
                    source.delete_file(inner)
                    done.append(True)
                except FileNotFoundError:
                    done.append(True)
                except OSError:
                    done.append(False)
            yield pd.DataFrame({"path": batch["path"], "removed": done})

    return plan.select("path").distinct().mapInPandas(remove, "path string, removed boolean")


def folder_listing(destinations: DataFrame, root: str) -> DataFrame:
    """``destination, final_name`` of all files in some ``destination`` folders, listed by the tasks."""
    base = qualified(destinations.sparkSession, root)
    folders = destinations.select(F.concat(F.lit(f"{base}/"), "destination").alias("path"))
    listed = list_folders(folders.repartition("path")).filter("NOT is_folder")
    inside = F.substr("path", F.lit(len(base) + 2))
    return listed.select(
        F.regexp_replace(inside, "/[^/]*$", "").alias("destination"),
        F.regexp_extract("path", "[^/]*$", 0).alias("final_name"),
    )


def write_routed(files: DataFrame, path: str) -> None:
    """Write rows with ``destination`` as one folder per destination."""
    moved = files.filter(F.col("destination").isNotNull())
    moved.write.mode("append").partitionBy("destination").parquet(path)


def routed_listing(spark: SparkSession, path: str) -> DataFrame:
    """``destination, final_name`` of what ``write_routed`` stored."""
    return spark.read.parquet(path).select("destination", "final_name")


def organised_objects(objects: DataFrame, order: str = "seq") -> DataFrame:
    """Add ``dest_key`` to objects with ``document_type`` and ``key`` and keep, per destination
    key, the object written last: the later of two equal names overwrites the earlier."""
    keyed = objects.withColumn("dest_key", destination_key(F.col("document_type"), F.col("key")))
    return latest_per_key(keyed, "dest_key", order)
