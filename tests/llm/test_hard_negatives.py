import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from doctriage.llm.hard_negatives import Heap, Mining, first_of, mine, strassen

SCHEMA = "vec_id long, label int, embedding array<double>, rank string, id string"


@pytest.mark.parametrize("shape", [(1, 1, 1), (7, 5, 9), (64, 64, 64), (33, 70, 41), (100, 3, 50), (0, 4, 5)])
def test_strassen_equals_the_plain_product(shape):
    m, k, n = shape
    numbers = np.random.default_rng(m)
    for high in (50, 1 << 40, 1 << 62):
        left, right = numbers.integers(-high, high, (m, k)), numbers.integers(-high, high, (k, n))
        assert (strassen(left, right, 4) == left @ right).all()  # modulo 2^64
    exact = strassen(left.astype(object), right.astype(object), 4)
    assert (exact == left.astype(object) @ right.astype(object)).all()


def test_heaps_of_parts_merge_into_the_heap_of_all():
    numbers = random.Random(3)
    items = [(numbers.randrange(9), i) for i in range(200)]
    whole, parts = Heap(5), [Heap(5) for _ in range(4)]
    whole.merge(items)
    for at, part in enumerate(parts):
        part.merge(items[at::4])
    total = Heap(5)
    for part in parts:
        total.merge(part.items)
    assert total.items == whole.items == sorted(items, key=lambda x: (-x[0], x[1]))[:5]


def test_first_entries_of_rows():
    values = np.array([[3, 3, np.iinfo(np.int64).min, 5], [1, 2, 3, 4]])
    fits = np.array([[True, True, True, False], [False, False, False, False]])
    assert [(r.tolist(), c.tolist()) for r, c in first_of(values, fits, 4)] == [([0], [0]), ([0], [1]), ([0], [2])]


def brute(rows, mining=Mining()):
    best = {}
    for row in rows:
        name, label, vector = row[:3]
        if name is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        if name not in best or (label, vector) < best[name]:
            best[name] = (label, vector)
    codes = {n: (lab, [math.floor(256 * x) if abs(x) < 1 << 52 else int(x) * 256 for x in v]) for n, (lab, v) in best.items()}
    out = []
    for name, (label, own) in codes.items():
        if name % 5:
            continue
        scored = [
            (-sum(a * b for a, b in zip(own, v)), other, lab)
            for other, (lab, v) in codes.items()
            if other != name and len(v) == len(own)
        ]
        scored.sort()
        for score, positive, _ in [s for s in scored if s[2] == label][: mining.positives]:
            fits = [s for s in scored if s[2] != label and -50 * score <= -100 * s[0] <= -95 * score]
            for rank, (far, negative, _) in enumerate(fits[: mining.negatives], 1):
                shown = [x if -(1 << 63) <= x < 1 << 63 else None for x in (-score, -far)]
                out.append((name, positive, rank, negative, *shown))
    return sorted(out, key=str)


def found(spark, rows, **settings):
    table = spark.createDataFrame(rows, SCHEMA)
    return sorted((tuple(r) for r in mine(table, F.col("vec_id") % 5 == 0, **settings).collect()), key=str)


def test_like_comparing_all_rows(spark):
    numbers = random.Random(8)
    rows = [
        (i, numbers.randrange(4), [numbers.choice([-0.5, 0.01, 0.25, numbers.random()]) for _ in range(numbers.choice([6, 6, 6, 3]))], "r", "x")
        for i in range(150)
    ]
    rows += [(200 + i, 1, [0.5] * 6, "r", "x") for i in range(60)]  # ties
    expected = brute(rows)
    assert len(expected) > 50
    assert found(spark, rows, stripe_bytes=2000) == expected
    assert found(spark, rows) == expected


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, i % 2, [0.1 * i, 0.3], None, None) for i in range(30)]
    odd = [
        (None, 1, [1.0, 1.0], "", ""), (40, None, [1.0, 1.0], "", ""), (45, 1, None, "", ""),
        (50, 0, [nan, 1.0], "", ""), (55, 0, [inf, 1.0], "", ""), (60, 0, [None, 1.0], "", ""),
        (65, 0, [], "", ""), (70, 1, [], "", ""), (75, 0, [], "", ""), (80, 1, [9.0, 9.0], "", ""), (80, 0, [9.0, 9.0], "", ""),
        (85, 1, [0.0, 0.0], "", ""),
    ]
    assert found(spark, rows + odd) == brute(rows + odd)
    assert found(spark, rows + rows) == brute(rows)
    assert found(spark, []) == []


def test_very_large_components_stay_exact(spark):
    rows = [(i, i % 2, [(5 + i % 7) * 1e17, -2e15 * i, 0.5], "", "") for i in range(20)]
    rows += [(100 + i, i % 2, [1e300, -1.0, 2.0 + i], "", "") for i in range(4)]
    rows += [(200 + i, i % 2, [1.0 + i / 7, 2.0, 3.0], "", "") for i in range(10)]
    expected = brute(rows)
    assert expected
    assert found(spark, rows) == expected
