"""Text extraction: decoding, fragment assembly and the caller-supplied parsers."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doctriage import fixed
from doctriage.functions.paths import is_supported
from doctriage.functions.text import decode_text_file, decode_utf8, is_blank, is_long_enough, py_strip

# One parsed piece of a file: page, paragraph, cell, shape or OCR string.  ``kind`` is the type
# of the value before it became text: str, num or bool.
FRAGMENTS = "array<struct<unit_ord:int,frag_ord:int,kind:string,value:string>>"
Parser = Callable[[bytes], list[tuple[int, int, str, str | None]]]


def keeps_fragment(ext: Column, fragment: Column) -> Column:
    """Which pieces count as text, by file type."""
    value, kind = fragment["value"], fragment["kind"]
    filled = value.isNotNull() & (value != "")
    zero = (kind == "num") & (value.try_cast("double") == 0)
    false = (kind == "bool") & (F.lower(value) == "false")
    return (
        F.when(ext.isin(".docx", ".pptx"), filled & ~is_blank(value))
        .when(ext == ".xlsx", filled & ~F.coalesce(zero | false, F.lit(False)))
        .otherwise(filled)
    )


def join_fragments(ext: Column, fragments: Column) -> Column:
    """Ordered, filtered pieces of one file as a single stripped text; null stays null."""
    kept = F.filter(F.array_sort(fragments), lambda piece: keeps_fragment(ext, piece))
    return py_strip(F.array_join(F.transform(kept, lambda piece: piece["value"]), " "))


def assemble_text(fragments: DataFrame, keys: list[str], ext: Column) -> DataFrame:
    """One text per file from a table of fragments (``unit_ord, frag_ord, kind, value``).

    Pieces are joined per unit (page, sheet, slide) first and the units per file afterwards, so
    no task sorts all pieces of a long file at once.
    """
    piece = F.struct("frag_ord", "value")
    kept = F.when(keeps_fragment(ext, F.struct("value", "kind")), piece)
    units = fragments.groupBy(*keys, "unit_ord").agg(F.collect_list(kept).alias("pieces"))
    unit = F.struct("unit_ord", _in_order("pieces", "value").alias("unit_text"))
    return (
        units.groupBy(*keys)
        .agg(F.collect_list(F.when(F.size("pieces") > 0, unit)).alias("units"))
        .select(*keys, py_strip(_in_order("units", "unit_text")).alias("text"))
    )


def _in_order(pieces: str, field: str) -> Column:
    return F.array_join(F.transform(F.array_sort(pieces), lambda piece: piece[field]), " ")


def parse_fragments(ext: Column, content: Column, parsers: Mapping[str, Parser]) -> Column:
    """Run the parser of each file type on the bytes; a failing parser gives null.

    Only rows whose type has a parser send their bytes to Python, the others send null, and all
    remaining columns stay in the JVM.
    """
    table = dict(parsers)

    @F.pandas_udf(FRAGMENTS)
    def run(exts: pd.Series, contents: pd.Series) -> pd.Series:
        def parse(kind, data):
            if data is None:
                return None
            try:
                return [
                    {"unit_ord": unit, "frag_ord": order, "kind": of, "value": value}
                    for unit, order, of, value in table[kind](bytes(data))
                ]
            except Exception:
                return None

        return pd.Series([parse(kind, data) for kind, data in zip(exts, contents)], dtype=object)

    parsed = ext.isin(*table)
    return run(ext, F.when(parsed, content))


def extract_text(
    files: DataFrame,
    parsers: Mapping[str, Parser] | None = None,
    types: tuple[str, ...] = fixed.SUPPORTED_TYPES,
) -> DataFrame:
    """Add ``text`` to files with ``file_ext`` and ``content``: null when it cannot be read.

    Plain text is decoded in the JVM.  Other supported types need a parser from the caller; a
    type without one is unreadable.  Text below the readable length becomes null too.
    """
    ext, content = F.col("file_ext"), F.col("content")
    plain = F.when(ext == ".txt", decode_text_file(content))
    wanted = {kind: parser for kind, parser in (parsers or {}).items() if kind in types}
    if wanted:
        files = files.withColumn("_fragments", parse_fragments(ext, content, wanted))
        raw = F.coalesce(plain, join_fragments(ext, F.col("_fragments")))
    else:
        raw = plain
    return (
        files.withColumn("_raw", F.when(is_supported(ext, types), raw))
        .withColumn("text", F.when(is_long_enough(F.col("_raw")), F.col("_raw")))
        .drop("_raw", "_fragments")
    )


def failure_status(ext: Column) -> Column:
    """Why a file without text failed: unreadable if its type is supported, else unsupported."""
    return F.when(is_supported(ext), F.lit("unreadable")).otherwise(F.lit("unsupported"))


def line_text(blocks: Column) -> Column:
    """Text of an OCR response: its LINE blocks in order, space-joined and stripped."""
    lines = F.filter(blocks, lambda block: block["BlockType"] == "LINE")
    return py_strip(F.array_join(F.transform(lines, lambda block: block["Text"]), " "))


def cloud_text(ext: Column, content: Column, blocks: Column) -> Column:
    """Text of a stored object: plain text unstripped, OCR types from blocks, others null."""
    return F.when(ext.isin(*fixed.CLOUD_TEXT_TYPES), decode_utf8(content)).when(
        ext.isin(*fixed.CLOUD_OCR_TYPES), line_text(blocks)
    )
