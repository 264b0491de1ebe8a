"""Passages that occur again anywhere in the corpus, by prefix-free parsing.

1. Every text is parsed; its string starts form runs under one trigger each (``phrases.stretches``).
   A run is a row of numbers: the hash of the bytes around its trigger that all of its strings
   contain (``inner``) and the hash of all bytes of its strings (``context``).
2. Strings can only be equal under equal inner hashes.  Inner hashes are counted; runs whose hash
   is alone are done.  On texts without repeats nothing is left after this.
3. Runs with equal contexts are copies of each other, so all of their strings occur again.  On highly
   repetitive text nearly all rows end here, without a look at their bytes.
4. What remains are runs with a context of their own next to others of the same inner hash, as at
   the edges of a passage.  One run for each distinct context is sent, with its bytes, to the task of
   its inner hash, where the dictionary's and the parse's suffix arrays give the corpus order; equal
   strings are neighbours in it.
5. Inner hashes with very many distinct contexts (the edge of a passage in a third of all documents)
   are no group for one task.  Steps 2 and 3 are done again with runs of fewer strings, down to single
   ones: what all strings of such a run contain and what they contain together are hashed with 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doctriage.llm.phrases import PIECE_BYTES, Parsing, leads, repeated_starts, stretches
from doctriage.session import discard, stage

GROUP_CONTEXTS = 2000
ORDER_BYTES = 2 << 20
OUT_ROWS = 50_000


def _pieces(rows: list[tuple[int, bytes]], parsing: Parsing, piece: int) -> Iterator[tuple[bytes, list, list, list]]:
    """Texts joined up to about ``piece`` bytes, long ones in overlapping pieces:
    the bytes and, for each part, its row, its place in the text and its end."""
    held, names, places, ends, size = [], [], [], [], 0
    for name, text in rows:
        for at in range(0, max(1, len(text) - parsing.length + 1), piece):
            part = text[at : at + piece + parsing.length - 1] if len(text) > piece else text
            if len(part) < parsing.length:
                continue
            held.append(part)
            size += len(part)
            names.append(name)
            places.append(at)
            ends.append(size)
            if size >= piece:
                yield b"".join(held), names, places, ends
                held, names, places, ends, size = [], [], [], [], 0
    if held:
        yield b"".join(held), names, places, ends


RUN = "row long, at long, starts int, inner long, context long"


def _runs(rows: DataFrame, parsing: Parsing, whole: bool, piece: int) -> DataFrame:
    """The runs of all texts (``row, text``): ``inner`` alone or, if ``whole``, all of ``RUN``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            texts = zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist())
            for raw, names, places, ends in _pieces(texts, parsing, piece):
                ends = np.array(ends)
                first, count, inner = stretches(np.frombuffer(raw, np.uint8), ends, parsing)
                if not len(first):
                    continue
                inner = inner.view(np.int64)
                if not whole:
                    yield pa.RecordBatch.from_arrays([pa.array(inner)], ["inner"])
                    continue
                text_of = np.searchsorted(ends, first, "right")
                begin = np.r_[0, ends[:-1]][text_of]
                stop = first + count + parsing.length - 1
                context = [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(first.tolist(), stop.tolist())]
                yield pa.RecordBatch.from_pydict(
                    {
                        "row": pa.array(np.array(names)[text_of]),
                        "at": pa.array(np.array(places)[text_of] + first - begin),
                        "starts": pa.array(count.astype(np.int32)),
                        "inner": pa.array(inner),
                        "context": pa.array(np.array(context, np.uint64).view(np.int64)),
                    }
                )

    return rows.select("row", "text").mapInArrow(run, RUN if whole else "inner long")


CONTEXT = "row long, at long, starts int, inner long, copies long, many boolean, context binary"


def _contexts(rows: DataFrame, wanted: DataFrame, parsing: Parsing) -> DataFrame:
    """The wanted runs with their bytes; a text is read once for all runs wanted of it."""
    item = F.struct("at", "starts", "inner", "copies", "many")
    by_row = wanted.groupBy("row").agg(F.collect_list(item).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "at", "starts", "inner", "copies", "many"]
        kinds = pa.schema(
            [("row", pa.int64()), ("at", pa.int64()), ("starts", pa.int32()), ("inner", pa.int64()), ("copies", pa.int64()), ("many", pa.bool_())]
        )
        for batch in batches:
            for one in range(batch.num_rows):
                text = batch.column(1)[one].as_py()
                runs = batch.column(2)[one].as_py()
                for first in range(0, len(runs), OUT_ROWS):
                    part = [{"row": batch.column(0)[one].as_py()} | r for r in runs[first : first + OUT_ROWS]]
                    made = pa.RecordBatch.from_pylist(part, kinds)
                    held = [text[r["at"] : r["at"] + r["starts"] + parsing.length - 1] for r in part]
                    yield pa.RecordBatch.from_arrays([*made.columns, pa.array(held, pa.binary())], [*names, "context"])

    return rows.join(by_row, "row").select("row", "text", "wanted").mapInArrow(run, CONTEXT)


SPAN = "row long, start long, stop long"


def _spans_of(names: list[int], starts: np.ndarray, stops: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {"row": pa.array(names, pa.int64()), "start": pa.array(starts, pa.int64()), "stop": pa.array(stops, pa.int64())}
    )


def _ordered(contexts: DataFrame, parsing: Parsing) -> DataFrame:
    """Spans of repeated strings, by the corpus order of the contexts of each inner hash."""

    def solved(held: list[tuple]) -> pa.RecordBatch:
        counts = np.array([r[2] for r in held], np.int64)
        again = repeated_starts([r[5] for r in held], counts, parsing)
        ends = np.cumsum(counts)
        names, starts, stops = [], [], []
        for (row, at, count, _, copies, _), end in zip(held, ends.tolist()):
            if copies > 1:
                continue
            own = np.flatnonzero(np.diff(np.r_[0, again[end - count : end].view(np.int8), 0]))
            names += [row] * (len(own) // 2)
            starts += (at + own[::2]).tolist()
            stops += (at + own[1::2] + parsing.length - 1).tolist()
        return _spans_of(names, starts, stops)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            columns = [batch.column(name).to_pylist() for name in ("row", "at", "starts", "inner", "copies", "context")]
            for row in zip(*columns):
                if size >= ORDER_BYTES and row[3] != held[-1][3]:
                    yield solved(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield solved(held)

    dealt = contexts.filter("NOT many").repartition("inner").sortWithinPartitions("inner")
    return dealt.mapInArrow(run, SPAN)


SPLIT = "row long, at long, starts int, lead int, copies long, context binary, block binary, whole binary"
# Distances to the trigger that a piece of a crowded context spans, round by round.
BLOCKS = (8, 1)


def _blocks(pieces: DataFrame, parsing: Parsing, width: int) -> DataFrame:
    """Pieces cut where the distance of a string to its trigger crosses a multiple of ``width``:
    ``block`` is the hash of the bytes that all strings at the distances of a block contain, ``whole`` that
    of all bytes of a piece.  Whole contexts come without ``lead``, where the trigger stands."""
    given = ["row", "at", "starts", "copies", "context", *(["lead"] if "lead" in pieces.columns else [])]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_128_digest
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, columns = [], [column.to_pylist() for column in batch.columns]
            if len(columns) < 6:
                columns.append(leads(columns[4], parsing))
            for row, at, starts, copies, text, lead in zip(*columns):
                begin = 0
                while begin < starts:
                    block = (lead - begin) // width
                    low, high = block * width, min((block + 1) * width, parsing.reach) - 1
                    stop = min(starts, lead - low + 1)
                    whole = text[begin : stop + parsing.length - 1]
                    common = text[lead - low : lead - high + parsing.length]
                    own = (row, at + begin, stop - begin, lead - begin, copies, whole)
                    rows.append((*own, digest(common, seed=block), digest(whole, seed=lead - begin)))
                    begin = stop
                if len(rows) >= OUT_ROWS:
                    yield frame(rows)
                    rows = []
            if rows:
                yield frame(rows)

    def frame(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), SPLIT_SCHEMA.types)], SPLIT_SCHEMA.names)

    return pieces.select(*given).mapInArrow(cut, SPLIT)


SPLIT_SCHEMA = pa.schema(
    [("row", pa.int64()), ("at", pa.int64()), ("starts", pa.int32()), ("lead", pa.int32()), ("copies", pa.int64()),
     ("context", pa.binary()), ("block", pa.binary()), ("whole", pa.binary())]
)


def _crowded(contexts: DataFrame, parsing: Parsing) -> DataFrame | None:
    """Spans of repeated strings of contexts that are too many for a task.

    The step from texts to runs is done again with fewer strings to a run, round by round: a piece whose
    block nobody shares is done, pieces that are whole copies of others are repeated, and one piece for each
    distinct whole goes on where a block still holds a whole of its own.  So a context costs the few
    pieces in which it departs from others, not all of its strings."""
    pieces, spans = contexts.filter("many"), []
    if pieces.isEmpty():
        return None
    for width in BLOCKS:
        cut = stage(_blocks(pieces, parsing, width), "pieces")
        item = F.struct("row", "at", "starts", "lead")
        wholes = cut.groupBy("block", "whole").agg(F.sum("copies").alias("copies"), F.min(item).alias("first"))
        wholes = stage(wholes, "wholes")
        shared = wholes.filter("copies > 1").select("block", "whole")
        again = cut.filter("copies = 1").join(shared, ["block", "whole"], "left_semi")
        stop = F.col("at") + F.col("starts") + (parsing.length - 1)
        spans.append(again.select("row", F.col("at").alias("start"), stop.alias("stop")))
        open_blocks = wholes.groupBy("block").agg(F.min("copies").alias("least"), F.count("*").alias("size"))
        open_blocks = open_blocks.filter("least = 1 AND size > 1").select("block")
        left = wholes.join(open_blocks, "block", "left_semi").select("copies", "first.*")
        pieces = left.join(cut.select("row", "at", "starts", "lead", "context"), ["row", "at", "starts", "lead"])
    return reduce(DataFrame.unionByName, spans)


def repeated_spans(
    rows: DataFrame, parsing: Parsing = Parsing(), group: int = GROUP_CONTEXTS, piece: int = PIECE_BYTES
) -> DataFrame:
    """``row, start, stop``: byte spans of ``rows`` (``row long, text binary``, read several times)
    that strings occurring again cover; spans of a row may overlap."""
    counted = _runs(rows, parsing, False, piece).groupBy("inner").agg(F.count("*").alias("n"))
    shared = stage(counted.filter("n > 1").select("inner"), "inner-hashes")
    runs = stage(_runs(rows, parsing, True, piece).join(shared, "inner", "left_semi"), "runs")
    discard(shared)
    first = F.min(F.struct("row", "at", "starts")).alias("first")
    contexts = runs.groupBy("inner", "context").agg(F.count("*").alias("copies"), first)
    contexts = stage(contexts, "contexts")
    copied = runs.join(contexts.filter("copies > 1").select("inner", "context"), ["inner", "context"], "left_semi")
    copied = copied.select("row", F.col("at").alias("start"), (F.col("at") + F.col("starts") + parsing.length - 1).alias("stop"))

    # Only inner hashes with some context of its own have anything left to find.
    groups = contexts.groupBy("inner").agg(F.min("copies").alias("least"), F.count("*").alias("size"))
    groups = groups.filter("least = 1").select("inner", (F.col("size") > group).alias("many"))
    wanted = contexts.join(groups, "inner").select("inner", "copies", "many", "first.*")
    bytes_of = stage(_contexts(rows, wanted, parsing), "context-bytes")
    spans = copied.unionByName(_ordered(bytes_of, parsing))
    crowded = _crowded(bytes_of, parsing)
    return spans if crowded is None else spans.unionByName(crowded)


REMOVED = "doc_id {id}, n_bytes long, n_removed long, n_spans long, spans array<struct<start: long, stop: long>>, kept binary"


def remove_repeats(
    docs: DataFrame,
    parsing: Parsing = Parsing(),
    id_column: str = "doc_id",
    text_column: str = "text",
    group: int = GROUP_CONTEXTS,
    piece: int = PIECE_BYTES,
) -> DataFrame:
    """Each document without the bytes of strings of ``parsing.length`` that occur again:
    ``doc_id, n_bytes, n_removed, n_spans, spans, kept``.

    A string occurs again if it also starts anywhere else, in the same document too; occurrences may
    overlap.  Strings are judged on the input, as UTF-8 bytes, and never cross documents.  ``spans``
    are the maximal removed runs in order, ``kept`` the other bytes joined; a removed run may cut a
    character.  Every row counts as a document: repeated rows and ids are copies of each other, a null
    id stays null, a null text is an empty one.  Texts shorter than a string stay whole.  An empty
    table gives an empty result; further columns are ignored.

    Strings are compared byte by byte in corpus order; copies of whole contexts are told by two
    64-bit hashes of different bytes, and pieces of crowded groups by one of 128 bits.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    text = F.coalesce(F.col(text_column).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(id_column).alias("doc_id"), text.alias("text"))
    # Row numbers must not change between the passes, so the texts are written once.
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "texts")
    spans = repeated_spans(rows.select("row", "text"), parsing, group, piece)
    by_row = spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            texts, found = batch.column(1), batch.column(2).to_pylist()
            first, size, made = 0, 0, []
            for one in range(batch.num_rows):
                raw = texts[one].as_py()
                runs: list[tuple[int, int]] = []
                for x in found[one] or ():
                    if runs and x["start"] <= runs[-1][1]:
                        runs[-1] = (runs[-1][0], max(runs[-1][1], x["stop"]))
                    else:
                        runs.append((x["start"], x["stop"]))
                edges = [0, *(edge for run in runs for edge in run), len(raw)]
                made.append((len(raw), runs, b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))))
                size += len(raw)
                if size < PIECE_BYTES and one + 1 < batch.num_rows:
                    continue
                sizes, spans, kept = zip(*made)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column(0).slice(first, len(made)),
                        "n_bytes": pa.array(sizes, pa.int64()),
                        "n_removed": pa.array([n - len(k) for n, k in zip(sizes, kept)], pa.int64()),
                        "n_spans": pa.array(list(map(len, spans)), pa.int64()),
                        "spans": pa.array([[{"start": a, "stop": b} for a, b in r] for r in spans], span),
                        "kept": pa.array(kept, pa.binary()),
                    }
                )
                first, size, made = one + 1, 0, []

    joined = rows.join(by_row, "row", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(cut, REMOVED.format(id=kind))
