"""Column functions against the Python behaviour they stand for."""

import os.path
import random
import urllib.parse

from pyspark.sql import functions as F

from doctriage.functions import numbers, paths, text, times


def column(spark, values, kind, *expressions):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [tuple(r)[1:] for r in df.select("i", *expressions).orderBy("i").collect()]


def test_extension_and_stem(spark):
    names = ["a.txt", "a.tar.gz", ".bashrc", "..x", "...", "a.", "a..b", ".a.b", "noext", "A.PDF", "é.TXT", "a b.c_d"]
    got = column(spark, names, "string", paths.stem(F.col("v")), paths.raw_ext(F.col("v")))
    assert got == [os.path.splitext(n) for n in names]


def test_strip(spark):
    values = ["  a  ", "\x1c x\x85", " \t\n\x0b b　", "​z", "﻿q ", "", "  "]
    assert column(spark, values, "string", text.py_strip(F.col("v"))) == [(v.strip(),) for v in values]


def test_strip_reads_the_ends_only(spark):
    """No pattern is tried along the text; every character str.strip() knows goes."""
    blanks = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000 and chr(i).isspace())
    values = [blanks + "a" + blanks + "b" + blanks[::-1], blanks, "x\n", None]
    assert column(spark, values, "string", text.py_strip(F.col("v"))) == [(v and v.strip(),) for v in values]
    plan = spark.range(1).select(text.py_strip(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan()
    assert "regexp" not in plan.toString()


def test_round_half_even(spark):
    rng = random.Random(3)
    values = [rng.randint(0, 200000) / 100 * rng.choice([1, 0.5, 0.25]) for _ in range(3000)]
    values += [2.675, 0.125, 66.25, 2.5, 69.95, 69.96, 99.95, 0.0, 0.05, 0.15, -2.675, 1e9 + 0.25]
    got = column(
        spark, values, "double", numbers.round_half_even(F.col("v"), 1), numbers.round_half_even(F.col("v"), 2)
    )
    assert got == [(round(v, 1), round(v, 2)) for v in values]


def test_keys(spark):
    values = ["x/my+file%20A.TXT", "plain", "a%2Bb+c"]
    got = column(spark, values, "string", paths.decode_key(F.col("v")))
    assert got == [(urllib.parse.unquote_plus(v),) for v in values]
    assert column(spark, ["bad%zz+1"], "string", paths.decode_key(F.col("v"))) == [("bad%zz 1",)]


def test_decode(spark):
    values = [b" a\r\nb\rc \n", b"\xff\xfe", "﻿é".encode(), b""]
    got = column(spark, values, "binary", text.decode_text_file(F.col("v")))
    assert got == [("a\nb\nc",), (None,), ("﻿é",), ("",)]


def test_readable_boundaries(spark):
    values = ["123456789", "1234567890", " 123456789 ", None, "éééééééééé"]
    got = column(spark, values, "string", text.is_readable(F.col("v")))
    assert got == [(False,), (True,), (False,), (False,), (True,)]


def test_display_values(spark):
    row = spark.range(1).select(
        numbers.first_truthy(F.lit(""), F.lit("x")).alias("a"),
        numbers.lookup(F.lit("nope"), {"k": "v"}, "d").alias("b"),
        numbers.lookup(F.lit(None).cast("string"), {"k": "v"}, "d").alias("c"),
        times.log_time(F.lit("2024-05-06 07:08:09").cast("timestamp")).alias("d"),
        numbers.size_kb(F.lit(1536)).alias("e"),
        numbers.fixed_point(F.lit(2.25)).alias("f"),
    ).first()
    assert tuple(row) == ("x", "d", "d", "2024-05-06 07:08:09", 1.5, "2.2")


def test_number_text_is_as_python_prints(spark):
    rng = random.Random(2)
    values = [0.0, -0.0, 1.0, 1e7, 1e15, 123456789.125, 1e16, 1.5e16, 1e-3, 1e-4, 1.25e-4, 1e-5, -3e-10, float("nan"), float("inf"), float("-inf")]
    drawn = [rng.uniform(-1, 1) * 10.0 ** rng.randrange(-12, 22) for _ in range(300)]
    table = spark.createDataFrame([(v,) for v in values + drawn], "v double")
    got = [r[0] for r in table.select(numbers.number_text(F.col("v"))).collect()]
    assert got[: len(values)] == [repr(v) for v in values]
    for text_, value in zip(got[len(values) :], drawn):
        assert float(text_) == value and ("e" in text_) == ("e" in repr(value)), (text_, value)
