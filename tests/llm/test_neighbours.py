import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from doctriage.llm.neighbours import k_best, nearest

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank string"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 0, "s", "r") for i, v in vectors], SCHEMA)


def expected(vectors, k):
    kept = {}
    for i, v in vectors:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        if any(v):
            kept.setdefault(i, []).append(np.array(v, np.float32).astype(float))
    rows = []
    for q in (i for i in kept if i % 5 == 0):
        scores = {}
        for i, found in kept.items():
            for v in found:
                for own in kept[q]:
                    if i != q and len(v) == len(own):
                        s = float(own @ v / math.sqrt((own @ own) * (v @ v)))
                        scores[i] = max(scores.get(i, -2), s)
        best = sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]
        rows += [(q, r, i, round(s, 9)) for r, (i, s) in enumerate(best, 1)]
    return sorted(rows)


def found(df):
    return sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in df.collect())


@pytest.mark.parametrize("stripe", [1 << 24, 2000])
def test_exact_with_ties_repeats_and_bad_rows(spark, stripe):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=12).tolist()) for i in range(120)]
    rows += [(200 + i, rows[10][1]) for i in range(9)]  # ties
    rows += [(7, rows[7][1]), (15, rows[15][1])]  # repeated rows
    rows += [(300, [0.0] * 12), (305, None), (310, [math.nan] * 12), (315, [None] * 12)]
    rows += [(320, []), (None, rows[1][1]), (325, [math.inf] + [1.0] * 11)]
    rows += [(330, [1.0, 2.0]), (331, [2.0, 1.0])]  # another length
    df = table(spark, rows).repartition(5)
    got = found(nearest(df, F.col("vec_id") % 5 == 0, 5, stripe_bytes=stripe))
    assert got == expected(rows, 5)
    assert [x[:3] for x in got if x[0] == 330] == [(330, 1, 331)]


def test_empty(spark):
    assert nearest(table(spark, []), F.lit(True), 5).count() == 0


def test_large_components(spark):
    rows = [(0, [3e38, 1.0]), (1, [3e38, 0.0]), (2, [1e-38, 1e-38])]
    got = nearest(table(spark, rows), F.col("vec_id") == 0, 2).collect()
    assert [r.vec_id for r in got] == [1, 2]


def test_only_k_pairs_of_a_query_reach_its_heap():
    rng = np.random.default_rng(5)
    queries = np.sort(rng.integers(0, 7, 400))
    scores, ids = rng.integers(0, 4, 400) / 4.0, rng.integers(0, 90, 400)
    wanted = set()
    for q in range(7):
        own = {}
        for s, i in zip(scores[queries == q], ids[queries == q]):
            own[i] = max(own.get(i, -1.0), s)
        wanted |= {(q, s, i) for i, s in sorted(own.items(), key=lambda x: (-x[1], x[0]))[:5]}
    best = k_best(queries, scores, ids, 5)
    assert len(best) == len(wanted) and set(zip(queries[best], scores[best], ids[best])) == wanted


def test_many_equal_vectors(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 else rng.normal(size=3).tolist()) for i in range(600)]
    got = found(nearest(table(spark, rows).repartition(3), F.col("vec_id") % 5 == 0, 5))
    assert got == expected(rows, 5)
