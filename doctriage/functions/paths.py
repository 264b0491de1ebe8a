"""File-name expressions: base name, stem, extension, keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from doctriage import fixed

# Leading dots belong to the stem, so '.profile' has no extension and 'a.tar.gz' has '.gz'.
_EXTENSION = r"(?s)^\.*[^.].*?(\.[^.]*)$"


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def raw_ext(file_name: Column) -> Column:
    """Last extension with its dot, case kept; empty when there is none."""
    return F.regexp_extract(file_name, _EXTENSION, 1)


def file_ext(file_name: Column) -> Column:
    return F.lower(raw_ext(file_name))


def stem(file_name: Column) -> Column:
    return F.substring(file_name, F.lit(1), F.length(file_name) - F.length(raw_ext(file_name)))


def numbered_name(file_name: Column, number: Column) -> Column:
    """``name.ext`` for number 0, otherwise ``name_<number>.ext``."""
    return F.when(number == 0, file_name).otherwise(
        F.concat(stem(file_name), F.lit("_"), number.cast("string"), raw_ext(file_name))
    )


def is_supported(ext: Column, types: Sequence[str] = fixed.SUPPORTED_TYPES) -> Column:
    return ext.isin(*types)


def decode_key(key: Column) -> Column:
    """URL-decode an object key with '+' as space; a malformed key only loses its plus signs."""
    return F.coalesce(F.try_url_decode(key), F.replace(key, F.lit("+"), F.lit(" ")))


def join_path(folder: Column, name: Column) -> Column:
    return F.concat_ws("/", folder, name)
