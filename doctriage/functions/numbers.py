"""Number and display expressions."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_even(value: Column, digits: int) -> Column:
    """Round a double on its exact binary value, ties to even.

    ``round`` and ``bround`` work on the shortest decimal print of a double, so 2.675 comes out
    as 2.68 although the stored number lies below the tie.  Here the distance to the tie
    ``(2m + 1) / (2 * 10^digits)`` is summed from power-of-two multiples, which are exact.
    """
    scale = 10**digits
    size = F.abs(value.cast("double"))
    lower = F.floor(size * F.lit(float(scale))).cast("double")
    tie = lower * 2 + 1
    powers = [p for p in reversed(range((2 * scale).bit_length())) if (2 * scale) >> p & 1]
    distance = size * F.lit(float(2 ** powers[0])) - tie
    for power in powers[1:]:
        distance = distance + size * F.lit(float(2**power))
    up = (distance > 0) | ((distance == 0) & (lower % 2 == 1))
    rounded = F.when(up, lower + 1).otherwise(lower) / F.lit(float(scale))
    return F.when(value < 0, -rounded).otherwise(rounded)


def size_kb(length: Column) -> Column:
    return round_half_even(length / F.lit(1024.0), 2)


def fixed_point(value: Column, digits: int = 1) -> Column:
    """``%.<digits>f`` text of the half-even rounded value."""
    return F.format_string(f"%.{digits}f", round_half_even(value, digits))


def number_text(value: Column) -> Column:
    """A text that reads back as the same double: plain from 10^-4 up to 10^16, beyond that with an
    exponent of two digits or more.  The digits are Spark's, whose own text has exponents from 10^7 on."""
    number = value.cast("double")
    text, size = number.cast("string"), F.abs(number)

    def plain(digits: int) -> Column:
        long = F.rtrim(text.try_cast(f"decimal(38,{digits})").cast("string"), F.lit("0"))
        return F.when(F.endswith(long, F.lit(".")), F.concat(long, F.lit("0"))).otherwise(long)

    mantissa = F.regexp_replace(F.regexp_extract(text, "^(.*)E", 1), "[.]0$", "")
    power = F.regexp_extract(text, "E(-?[0-9]+)$", 1).try_cast("int")
    exponent = F.concat(F.when(power < 0, "e-").otherwise("e+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    return (
        F.when(F.isnan(number), "nan")
        .when(size == float("inf"), F.when(number < 0, "-inf").otherwise("inf"))
        .when((size >= 1e16) | ((size > 0) & (size < 1e-4)), F.concat(mantissa, exponent))
        .when(size >= 1e7, plain(10))
        .when((size > 0) & (size < 1e-3), plain(22))
        .otherwise(text)
    )


def lookup(key: Column, table: Mapping[str, str], default: str) -> Column:
    """Value of a small literal map, or the default for a missing or null key."""
    pairs = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in table.items()))
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def first_truthy(*values: Column) -> Column:
    """First value that is neither null nor the empty string."""
    return F.coalesce(*[F.nullif(value, F.lit("")) for value in values])
