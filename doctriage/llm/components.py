"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doctriage.session import discard, stage


def _smallest(edges: DataFrame, node: str, other: str) -> DataFrame:
    """Per ``node`` the smallest of itself and its neighbours, joined back to its edges.

    The minimum is aggregated before the shuffle, so a node with very many neighbours costs no
    large group; the join back is a plain equi-join whose hot keys adaptive execution splits.
    """
    least = edges.groupBy(node).agg(F.least(F.min(other), F.col(node)).alias("least"))
    return edges.join(least, node)


def large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    stars = _smallest(both, "a", "b").filter("b > a")
    return stars.select(F.col("least").alias("a"), "b").filter("a < b").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Link every node and its smaller neighbours to the smallest of them; ``a < b`` holds."""
    stars = _smallest(edges.select(F.col("b").alias("n"), F.col("a").alias("s")), "n", "s")
    near = stars.select(F.col("least").alias("a"), F.col("s").alias("b"))
    own = stars.select(F.col("least").alias("a"), F.col("n").alias("b"))
    return near.unionByName(own).filter("a < b").distinct()


def _state(edges: DataFrame) -> tuple:
    mixed = F.xxhash64("a", "b")
    return tuple(
        edges.agg(
            F.count("*"),
            F.sum(F.col("b").cast("decimal(38,0)") - F.col("a")),
            F.bit_xor(mixed),
        ).first()
    )


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (``a, b`` long); the component is named by
    its smallest node.

    Edges may repeat, point either way or be loops (which are ignored); rows with a null end are
    ignored too.  Each round is written to the shared folder; the number of rounds grows with the
    logarithm of the longest path.  The result is a table in that folder.
    """
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    now = stage(
        edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(low, high).distinct(),
        "edges",
    )
    before = _state(now)
    while before[0]:
        after = stage(small_star(large_star(now)), "edges")
        discard(now)
        now, state = after, _state(after)
        if state == before:
            break
        before = state
    # At the fixed point every edge leads from a component's smallest node to one of the others.
    roots = now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    labels = stage(roots.unionByName(now.select(F.col("b").alias("node"), F.col("a").alias("component"))), "labels")
    discard(now)
    return labels
