"""Repair of conversation structure: the cheapest edits after which the roles alternate.

1. Turns are put in one order over all conversations by a range sort, so a long conversation lies in
   several partitions.  The order is cut into slices of ``SLICE`` rows.
2. Each turn becomes one letter (initial of its role, first fault); whether its role and text were seen
   earlier is an aggregate with a lookup, not a window over the conversation.
3. Per conversation and slice, the audit program (``audits``) gives the best edits between any two
   states.  Slices run side by side; memory is bounded by the slice.
4. A conversation's slices are joined through their states; only letters meet here, no texts.
5. The chosen edits go back to the turns of each slice.

The digest of a whole conversation is one running hash, so the query that wants it streams a
conversation's turns through one task, holding one turn at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from doctriage.llm import audits
from doctriage.session import stage

BLANKS = " \t\n\x0b\f\r"
SLICE_BITS = 13
OUT_ROWS = 5000


def damaged(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with faults by a hash of conversation and turn; nulls of a role,
    text or name read as one space."""
    space = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    made = turns.filter(kind != 0).select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy")
    )
    return made.drop("copy")


def ordered(turns: DataFrame) -> DataFrame:
    """The turns with ``seq``, their place in the order, and ``slice``, written once."""
    space = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" ")).alias(name)
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role"), space("text"))
    # The last key only lets equal rows of one conversation lie in several partitions.
    keys = ["conv_id", "turn", "role", "text", "spread"]
    rows = rows.withColumn("spread", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("spread")
    rows = rows.withColumn("seq", F.monotonically_increasing_id())
    return stage(rows.withColumn("slice", F.shiftright("seq", SLICE_BITS)), "turns")


def judged(rows: DataFrame) -> DataFrame:
    """``conv_id, seq, slice, code, initial, fault`` of each turn; its first fault counts."""
    tail = F.rtrim(F.col("text"), F.lit(BLANKS))
    content = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    initial = F.lit(3)
    for place, letter in enumerate(audits.INITIALS[:3]):
        initial = F.when(F.col("role").startswith(letter), place).otherwise(initial)
    facts = rows.select(
        F.col("conv_id").alias("conv"),
        "seq",
        "slice",
        initial.alias("initial"),
        (tail == "").alias("blank"),
        (~F.right(tail, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
        content.alias("content"),
    )
    first = facts.groupBy("conv", "content").agg(F.min("seq").alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = first.select(F.col("conv").alias("of"), F.col("content").alias("same"), "first")
    both = facts.join(first, F.col("conv").eqNullSafe(F.col("of")) & (F.col("content") == F.col("same")), "left")
    fault = (
        F.when(F.col("blank"), audits.BLANK)
        .when(F.col("first") < F.col("seq"), audits.DUPLICATE)
        .when(F.col("truncated"), audits.TRUNCATED)
        .otherwise(audits.FINE)
    )
    return both.select(F.col("conv").alias("conv_id"), "seq", "slice", F.char(F.lit(ord("A")) + F.col("initial") + 4 * fault).alias("code"))


ENTRY = "struct<start: int, end: int, cost: long, audit: string>"
SLICED = "slice long, codes string, first boolean"
PLANNED = "blank long, duplicate long, truncated long, illegal long, cost long, audit string, parts array<struct<slice: long, start: int, audit: string>>"
LEGAL = {"su", "ua", "au"}


def planned(codes: DataFrame) -> DataFrame:
    """The best edits of each conversation from its coded turns (``conv_id, seq, slice, code``):
    counts of faults, ``illegal`` neighbours, ``cost``, ``audit`` and the audit's part in each slice."""
    kind = codes.schema["conv_id"].dataType.simpleString()
    letters = F.array_sort(F.collect_list(F.struct("seq", "code")))
    joined = F.array_join(F.transform(letters, lambda x: x["code"]), "").alias("codes")
    sliced = codes.groupBy("conv_id", "slice").agg(joined)
    begin = F.min("slice").over(Window.partitionBy("conv_id"))
    sliced = sliced.withColumn("first", F.col("slice") == begin)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entry = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
        for batch in batches:
            tables = []
            for text, first in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                found = audits.transfer(text, (audits.EMPTY,) if first else range(audits.STATES))
                tables.append([dict(zip(("start", "end", "cost", "audit"), x)) for x in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(tables, pa.list_(entry))],
                ["conv_id", "slice", "codes", "edits"],
            )

    solved = sliced.select("conv_id", "slice", "codes", "first").mapInArrow(
        solve, f"conv_id {kind}, slice long, codes string, edits array<{ENTRY}>"
    )
    parts = F.array_sort(F.collect_list(F.struct("slice", "codes", "edits"))).alias("parts")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = pa.struct([("slice", pa.int64()), ("start", pa.int32()), ("audit", pa.string())])
        counts = ("blank", "duplicate", "truncated", "illegal", "cost")
        out = pa.schema([*((name, pa.int64()) for name in counts), ("audit", pa.string()), ("parts", pa.list_(part))])
        for batch in batches:
            rows = []
            for slices in batch.column(1).to_pylist():
                codes = "".join(x["codes"] for x in slices)
                seen = [audits.decoded(letter) for letter in codes]
                faults = [fault for _, fault in seen]
                tables = [[(e["start"], e["end"], e["cost"], e["audit"]) for e in x["edits"]] for x in slices]
                cost, audit, own = audits.joined(tables)
                rows.append(
                    {
                        "blank": faults.count(audits.BLANK),
                        "duplicate": faults.count(audits.DUPLICATE),
                        "truncated": faults.count(audits.TRUNCATED),
                        "illegal": sum(a + b not in LEGAL for (a, _), (b, _) in zip(seen, seen[1:])),
                        "cost": cost,
                        "audit": audit,
                        "parts": [{"slice": x["slice"], "start": s, "audit": a} for x, (s, a) in zip(slices, own)],
                    }
                )
            made = pa.RecordBatch.from_pylist(rows, out)
            yield pa.RecordBatch.from_arrays([batch.column(0), *made.columns], ["conv_id", *out.names])

    return solved.groupBy("conv_id").agg(parts).mapInArrow(join, f"conv_id {kind}, {PLANNED}")


def _kinds(rows: DataFrame) -> tuple[str, pa.DataType]:
    """The type of ``conv_id`` for Spark and for Arrow."""
    kind = rows.schema["conv_id"].dataType
    return kind.simpleString(), to_arrow_type(kind)


def _with_edits(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """The turns and, before the first of each conversation and slice, the edits for them."""
    part = plan.select("conv_id", F.explode("parts").alias("part"))
    nothing = {"turn": "long", "role": "string", "text": "string"}
    edits = part.select(
        "conv_id",
        "part.slice",
        F.lit(-1).cast("long").alias("seq"),
        *(F.lit(None).cast(of).alias(name) for name, of in nothing.items()),
        "part.start",
        "part.audit",
    )
    turns = rows.select(
        "conv_id", "slice", "seq", *nothing, F.lit(None).cast("int").alias("start"), F.lit(None).cast("string").alias("audit")
    )
    return turns.unionByName(edits)


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """``conv_id, slice, turn, edit, role, text`` of each turn that stays or comes in, and one row
    without an edit at each beginning of a slice; the input is in order of slice and seq."""
    replay = now = None
    for batch in batches:
        for name, piece, _, turn, role, text, start, audit in zip(*(c.to_pylist() for c in batch.columns)):
            if audit is not None:
                if replay is not None:
                    yield from ((*now, None, edit, new, "") for edit, new in replay.inserts())
                replay, now = audits.Replay(start, audit), (name, piece)
                yield (*now, None, None, None, None)
                continue
            yield from ((*now, None, edit, new, "") for edit, new in replay.inserts())
            edit, new = replay.edit(role)
            if new is not None:
                yield (*now, turn, edit, new, text)
    if replay is not None:
        yield from ((*now, None, edit, new, "") for edit, new in replay.inserts())


def repaired(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """The turns after the edits: ``conv_id, slice, at, turn, role, text, edit``.

    ``slice`` and ``at`` order a conversation's turns; turns put in have no ``turn``."""
    kind, arrow = _kinds(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held, at = ["conv_id", "slice", "at", "turn", "role", "text", "edit"], [], 0

        def frame() -> pa.RecordBatch:
            columns = [list(c) for c in zip(*held)]
            held.clear()
            kinds = [arrow, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for name, piece, turn, edit, role, text in _replayed(batches):
            if edit is None:
                at = 0
                continue
            held.append((name, piece, at, turn, role, text, edit))
            at += 1
            if len(held) >= OUT_ROWS:
                yield frame()
        if held:
            yield frame()

    keys = ["conv_id", "slice"]
    dealt = _with_edits(rows, plan).repartition(*keys).sortWithinPartitions(*keys, "seq")
    return dealt.mapInArrow(run, f"conv_id {kind}, slice long, at long, turn long, role string, text string, edit string")


def digests(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256``: the hash of the lines ``role:text`` of each repaired conversation."""
    kind, arrow = _kinds(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        begun, name, lines, total, done = False, None, 0, hashlib.sha256(), []

        def frame() -> pa.RecordBatch:
            names, sums = (list(c) for c in zip(*done))
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(names, arrow), pa.array(sums, pa.string())], ["conv_id", "repaired_sha256"])

        for conv, _, _, edit, role, text in _replayed(batches):
            if not begun or conv != name:
                if begun:
                    done.append((name, total.hexdigest()))
                begun, name, lines, total = True, conv, 0, hashlib.sha256()
                if len(done) >= OUT_ROWS:
                    yield frame()
            if edit is not None:
                total.update(f"{chr(10) * bool(lines)}{role}:{text}".encode())
                lines += 1
        if begun:
            done.append((name, total.hexdigest()))
            yield frame()

    dealt = _with_edits(rows, plan).repartition("conv_id").sortWithinPartitions("conv_id", "slice", "seq")
    return dealt.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def gaps(rows: DataFrame) -> DataFrame:
    """``conv_id, gaps``: turn numbers missing between the first and the last; 0 without any number."""
    numbers = rows.filter("turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.lit(1).alias("one"))
    wide = lambda x: x.cast("decimal(38,0)")
    missing = wide(F.max("turn")) - wide(F.min("turn")) + 1 - wide(F.count("turn"))
    return numbers.groupBy("conv_id").agg(F.least(missing, F.lit((1 << 63) - 1)).cast("long").alias("gaps"))


def repair(turns: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """One row per conversation of ``turns`` (``conv_id, turn, role, text``), or of ``names``
    (``conv_id``): ``gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    A conversation's turns are read by turn, nulls first, equal ones by role and text.  A null role or
    text reads as one space; a null conversation is one of its own; repeated rows are turns of their
    own, and duplicates of the first.  A role without letters has no initial and fits no place.  A
    conversation without turns costs nothing and hashes the empty text.  ``gaps`` ends at the largest long.
    An empty table gives an empty result; further columns are ignored.

    The audit is as long as the conversation, which Spark's strings bound at 2 GiB; ``planned`` and
    ``repaired`` give the same edits by slice.
    """
    rows = ordered(turns)
    plan = stage(planned(judged(rows)), "plan")
    facts = plan.drop("parts")
    everyone = (rows if names is None else names).select("conv_id").distinct()
    out = everyone
    for part in (facts, gaps(rows), digests(rows, plan)):
        part = part.withColumnRenamed("conv_id", "of")
        out = out.join(part, F.col("conv_id").eqNullSafe(F.col("of")), "left").drop("of")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select(
        "conv_id",
        *(F.coalesce(F.col(name), F.lit(0).cast("long")).alias(name) for name in counts),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
