"""Names at the destination without clashes.

Files reach a folder in arrival order.  A file keeps its name if that name is free, otherwise it
becomes ``name_1.ext``, ``name_2.ext``, ... with the first free number.  A requested name may
itself look numbered (``scan_1.pdf``), so it can hold a number that copies of ``scan.pdf`` must
skip, or find its own name given away.

Nothing here walks a group of files one by one:

* the position of each file among those asking for the same name is a running count;
* a numbered name ``P_k`` is *lost* when ``P`` has handed out number ``k`` before ``P_k`` first
  arrives.  With ``g`` names handed out by then and ``c`` numbers below ``k`` kept by their own
  files, that is ``g >= k - c``.  Losing depends only on smaller numbers and shorter names, so one
  pass in order of ``k`` settles the numbered names (not the files) of each nesting depth;
* copy number ``g`` of a name gets ``g`` plus the count of kept numbers it has to skip, again a
  running count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doctriage.functions.paths import join_path, numbered_name, raw_ext, stem
from doctriage.operators.skew import MAX_WINDOW_ROWS, count_before, join_facts, matching
from doctriage.session import stage

_NUMBERED = r"(?s)^(.+)_([1-9][0-9]{0,17})$"
_SUFFIXES = r"(?:_[1-9][0-9]{0,17})+$"


def _parent(file_name: Column) -> Column:
    """``struct<name, k>`` with ``file_name = name_k``, or null if it is no numbered name."""
    base = stem(file_name)
    name = F.concat(F.regexp_extract(base, _NUMBERED, 1), raw_ext(file_name))
    k = F.regexp_extract(base, _NUMBERED, 2).try_cast("long")
    return F.when(
        k.isNotNull() & (numbered_name(name, k) == file_name),
        F.struct(name.alias("name"), k.alias("k")),
    )


def assign_names(
    files: DataFrame,
    occupied: DataFrame | None = None,
    order: str = "arrival_seq",
    max_window_rows: int = MAX_WINDOW_ROWS,
) -> DataFrame:
    """Add ``final_name`` and ``name_number`` to files with ``destination``, ``file_name``, ``order``.

    ``occupied`` lists names (``destination, file_name``) that exist already; an optional column
    ``last`` says that the numbers up to it are taken as well (``name_state``).  Of a large list
    only the names this run touches are kept.  Rows with a null destination are not moved and
    get nulls.
    """
    columns = files.columns
    moved = _keyed(files.filter(F.col("destination").isNotNull()))
    requested = _with_parent(
        moved.groupBy("_key", "destination", "file_name").agg(
            F.count("*").alias("copies"), F.min(order).alias("first")
        )
    )
    if occupied is None:
        names = requested.withColumn("occupied", F.lit(False)).withColumn(
            "last", F.lit(0).cast("long")
        )
    else:
        names = _with_state(requested, occupied)
    names = stage(names, "names")
    children = _children(names)
    counted_rows = moved.withColumn("_counts", F.lit(True))

    if children.isEmpty():
        ranked = count_before(counted_rows, ["_key"], order, "_counts", "_earlier", max_window_rows)
        exceptions = names.filter("occupied AND copies > 0").select(
            "_key", "copies", F.lit(True).alias("_lost"), F.lit(False).alias("_skips"), "last"
        )
        numbered = _with_numbers(ranked, exceptions, occupied is not None)
    else:
        marks = children.filter(F.col("first").isNotNull()).select(
            F.col("_parent_key").alias("_key"),
            F.col("first").alias(order),
            F.col("_key").alias("_child_key"),
            F.lit(False).alias("_counts"),
        )
        both = counted_rows.unionByName(marks, allowMissingColumns=True)
        ranked = stage(
            count_before(both, ["_key"], order, "_counts", "_earlier", max_window_rows), "ranks"
        )
        reached = ranked.filter("NOT _counts").select("_child_key", "_earlier")
        settled = _settle(
            children.join(reached, F.col("_key") == F.col("_child_key"), "left")
            .drop("_child_key")
            .fillna(0, ["_earlier"]),
            max_window_rows,
        )
        kept = settled.filter("NOT _lost")
        lost = settled.filter("_lost").select("_key").unionByName(
            names.filter("occupied").select("_key")
        )
        skipping = kept.select(F.col("_parent_key").alias("_key")).distinct()
        exceptions = (
            names.filter("copies > 0")
            .select("_key", "copies", "last")
            .join(lost.distinct().withColumn("_lost", F.lit(True)), "_key", "left")
            .join(skipping.withColumn("_skips", F.lit(True)), "_key", "left")
            .fillna(False, ["_lost", "_skips"])
            .filter("_lost OR _skips")
        )
        numbered = _with_numbers(ranked.filter("_counts").drop("_child_key"), exceptions, True)
        numbered = _skip_kept(stage(numbered, "numbers"), kept, max_window_rows)

    number = F.when(F.col("_number") > 0, F.col("last") + F.col("_number")).otherwise(F.lit(0))
    named = numbered.withColumn("name_number", number.cast("long")).withColumn(
        "final_name", numbered_name(F.col("file_name"), F.col("name_number"))
    )
    unmoved = files.filter(F.col("destination").isNull()).select(
        *columns,
        F.lit(None).cast("string").alias("final_name"),
        F.lit(None).cast("long").alias("name_number"),
    )
    return named.select(*columns, "final_name", "name_number").unionByName(unmoved)


def name_state(results: DataFrame) -> DataFrame:
    """What later runs need to know about given names, as ``occupied`` for ``assign_names``.

    Rows may repeat a name; the largest number counts, and all numbers up to it are taken.
    """
    moved = results.filter(F.col("destination").isNotNull())
    return moved.select("destination", "file_name", F.col("name_number").alias("last"))


def name_family(destination: Column, file_name: Column) -> Column:
    """The same for a name, the name it is a number of, and all numbered copies of either: what is
    known of one family is all that naming its members needs."""
    root = F.regexp_replace(stem(file_name), _SUFFIXES, "")
    return join_path(destination, F.concat(root, raw_ext(file_name)))


def _keyed(names: DataFrame) -> DataFrame:
    return names.withColumn("_key", join_path(F.col("destination"), F.col("file_name")))


def _with_parent(names: DataFrame) -> DataFrame:
    parent = _parent(F.col("file_name"))
    return (
        names.withColumn("_p", parent)
        .withColumn("_parent_key", join_path(F.col("destination"), F.col("_p.name")))
        .withColumn("k", F.col("_p.k"))
        .withColumn("_parent_key", F.when(F.col("k").isNotNull(), F.col("_parent_key")))
        .withColumn("_depth", F.regexp_count(F.regexp_extract(stem(F.col("file_name")), _SUFFIXES, 0), F.lit("_")))
        .drop("_p")
    )


def _with_state(requested: DataFrame, occupied: DataFrame) -> DataFrame:
    """Requested names with what is known of them, plus existing numbered copies of them.

    Only state about names this run touches is joined in.
    """
    requested = stage(requested, "requested")
    count = requested.count()
    if "last" not in occupied.columns:
        occupied = occupied.withColumn("last", F.lit(0))
    known_names = _with_parent(_keyed(occupied.select("destination", "file_name", "last")))
    keys, parents = requested.select("_key"), requested.filter("k IS NOT NULL").select(
        F.col("_parent_key").alias("_key")
    )
    same = matching(known_names, keys.unionByName(parents).distinct(), "_key", 2 * count)
    copies = matching(
        known_names.filter("k IS NOT NULL"), keys.withColumnRenamed("_key", "_parent_key"), "_parent_key", count
    )
    state = (
        same.unionByName(copies)
        .groupBy("_key", "destination", "file_name", "_parent_key", "k", "_depth")
        .agg(F.max("last").cast("long").alias("last"))
    )
    own = state.select("_key", "last", F.lit(True).alias("_exists"))
    givers = state.select(F.col("_key").alias("_parent_key"), F.col("last").alias("_parent_last"))
    known = (
        requested.join(own, "_key", "left")
        .join(givers, "_parent_key", "left")
        .withColumn(
            "occupied",
            F.col("_exists").isNotNull()
            | F.coalesce(F.col("k") <= F.col("_parent_last"), F.lit(False)),
        )
        .fillna(0, ["last"])
        .drop("_exists", "_parent_last")
    )
    others = (
        state.join(keys.select(F.col("_key").alias("_parent_key")), "_parent_key", "left_semi")
        .join(keys, "_key", "left_anti")
        .withColumn("occupied", F.lit(True))
        .withColumn("copies", F.lit(0).cast("long"))
    )
    return known.unionByName(others, allowMissingColumns=True)


def _children(names: DataFrame) -> DataFrame:
    """Numbered names whose parent name can hand out that number in the same folder.

    ``k`` becomes relative to the numbers the parent handed out in earlier runs.
    """
    givers = names.filter("copies > 0").select(
        F.col("_key").alias("_parent_key"),
        F.col("occupied").alias("_parent_occupied"),
        F.col("last").alias("_parent_last"),
        F.col("copies").alias("_parent_copies"),
        F.col("k").isNotNull().alias("_parent_numbered"),
    )
    return (
        names.drop("last")
        .join(givers, "_parent_key")
        .filter("_parent_copies > 1 OR _parent_occupied OR _parent_numbered")
        .withColumn("k", F.col("k") - F.col("_parent_last"))
        .filter("k > 0")
        .select("_key", "_parent_key", "_parent_occupied", "k", "first", "occupied", "_depth")
    )


def _settle(children: DataFrame, max_window_rows: int) -> DataFrame:
    """Decide for every child whether its name is given away before it arrives.

    Adds ``_lost`` and ``_below``, the numbers below ``k`` that their own files keep.  In order of
    ``k`` each child depends only on how many before it were kept, so one ordered pass settles
    the children of all parents, with one count as state.  A parent is settled before its
    children: there is one pass per nesting depth of names.  Where a parent has more children
    than ``max_window_rows``, ``k`` is cut into slices, and the counts are carried from one
    slice to the next.
    """
    children = stage(children, "reached")
    depths = sorted(row[0] for row in children.select("_depth").distinct().collect())
    total = children.count()
    cuts = []
    if total > max_window_rows:
        largest = children.groupBy("_parent_key").count().agg(F.max("count")).first()[0]
        pieces = math.ceil(largest / max_window_rows)
        shares = [i / pieces for i in range(1, pieces)]
        found = children.agg(F.percentile_approx("k", shares, 10_000)).first()[0] if shares else []
        cuts = sorted(set(found))
    settled = []
    for depth in depths:
        level = children.filter(F.col("_depth") == depth)
        if settled:
            gone = reduce(DataFrame.unionByName, settled).filter("_lost OR occupied")
            gone = gone.select(F.col("_key").alias("_parent_key"), F.lit(True).alias("_parent_lost"))
            level = level.join(gone, "_parent_key", "left")
        else:
            level = level.withColumn("_parent_lost", F.lit(False))
        first_kept = ~(F.col("_parent_occupied") | F.coalesce("_parent_lost", F.lit(False)))
        given = F.greatest(F.col("_earlier") - first_kept.cast("long"), F.lit(0))
        level = level.withColumn("_free_below", F.when(~F.col("occupied"), F.col("k") - given))
        carried = None
        for low, high in zip([None, *cuts], [*cuts, None]):
            part = level
            if low is not None:
                part = part.filter(F.col("k") > low)
            if high is not None:
                part = part.filter(F.col("k") <= high)
            part = part.withColumn("_start", F.lit(0).cast("long"))
            if carried is not None:
                part = part.drop("_start").join(carried, "_parent_key", "left").fillna(0, ["_start"])
            walked = (
                part.select("_key", "_parent_key", "k", "occupied", "_free_below", "_start")
                .repartition("_parent_key")
                .sortWithinPartitions("_parent_key", "k")
                .mapInPandas(_walk, _SETTLED)
            )
            settled.append(stage(walked, "children"))
            after = settled[-1].withColumn("_start", F.col("_below") + (~F.col("_lost")).cast("long"))
            after = after.select("_parent_key", "_start")
            after = after if carried is None else after.unionByName(carried)
            carried = after.groupBy("_parent_key").agg(F.max("_start").alias("_start"))
    return reduce(DataFrame.unionByName, settled)


_SETTLED = "_key string, _parent_key string, k long, occupied boolean, _lost boolean, _below long"


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Children sorted by parent and ``k``: a name is lost when at least as many numbers below it
    are kept as were free there.  The state is one count."""
    parent, kept = None, 0
    for batch in batches:
        lost, below = [], []
        for name, free, start in zip(batch["_parent_key"], batch["_free_below"], batch["_start"]):
            if name != parent:
                parent, kept = name, start
            below.append(kept)
            lost.append(not pd.isna(free) and kept >= free)
            kept += not lost[-1]
        shown = batch[["_key", "_parent_key", "k", "occupied"]]
        yield shown.assign(_lost=lost, _below=below)


def _with_numbers(ranked: DataFrame, exceptions: DataFrame, has_exceptions: bool) -> DataFrame:
    """``_number``: 0 keeps the name, g is the g-th copy; a lost first name counts as a copy."""
    if not has_exceptions:
        return ranked.withColumns(
            {"_number": F.col("_earlier"), "_skips": F.lit(False), "last": F.lit(0)}
        )
    joined = join_facts(ranked, exceptions, "_key", "copies")
    joined = joined.fillna(False, ["_lost", "_skips"]).fillna(0, ["last"])
    return joined.withColumn("_number", F.col("_earlier") + F.col("_lost").cast("long"))


def _skip_kept(numbered: DataFrame, kept: DataFrame, max_window_rows: int) -> DataFrame:
    """Move copy numbers past the numbers that belong to other files."""
    skips = kept.select(
        F.col("_parent_key").alias("_key"),
        (2 * (F.col("k") - F.col("_below") - 1) + 1).alias("_at"),
        F.lit(True).alias("_skip"),
    )
    skip = F.col("_skips") & (F.col("_number") > 0)
    copies = numbered.filter(skip).withColumn("_at", 2 * F.col("_number"))
    counted = count_before(
        copies.withColumn("_skip", F.lit(False)).unionByName(skips, allowMissingColumns=True),
        ["_key"], "_at", "_skip", "_passed", max_window_rows,
    ).filter("NOT _skip")
    moved = counted.withColumn("_number", F.col("_number") + F.col("_passed"))
    rest = numbered.filter(~skip)
    return rest.unionByName(moved.select(*rest.columns))
