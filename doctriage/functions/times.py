"""Time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from doctriage import fixed
from doctriage.functions.numbers import round_half_even


def log_time(moment: Column) -> Column:
    return F.date_format(moment, fixed.TIMESTAMP_FORMAT)


def clock_time(moment: Column) -> Column:
    return F.date_format(moment, fixed.CLOCK_FORMAT)


def elapsed_seconds(started: Column, finished: Column) -> Column:
    micros = F.unix_micros(finished) - F.unix_micros(started)
    return round_half_even(micros / F.lit(1e6), 2)
