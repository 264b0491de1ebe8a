"""Mixing sources to target weights within a token budget.

Leaves are (domain, language, source).  A budget is handed down that tree by integer weights.  Where
a node has fewer tokens than its share, even when repeated for the allowed number of epochs, its
siblings take what is left by their weights; only when all of them are full does it go to the
siblings of their parent.  A leaf then gives whole epochs and, in one more epoch, the documents that
come first in a seeded order until its tokens are reached.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doctriage.session import stage

WORD = r"[^\x20\x09-\x0D]+"
LEVELS = ("domain", "lang", "source")
MISSING = "(none)"
STEP = 2  # hexadecimal digits by which the search for a leaf's last document narrows per round
BOUNDARY_ROWS = 4096
DIGITS = 32


@dataclass(frozen=True)
class Targets:
    """``domain`` of a row, and a positive whole weight for the nodes of each level, from columns
    ``domain``, ``lang`` and ``source`` of the levels down to it."""

    domain: Column
    weights: Sequence[Column]
    epochs: int = 2
    seed: int = 17


def row_key(documents: DataFrame) -> Column:
    """The id as text; rows without one are told apart by their text."""
    text = F.coalesce("text", F.lit("")) if "text" in documents.columns else F.lit("")
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("t"), F.md5(text)))


def narrow(documents: DataFrame, targets: Targets, *further: Column) -> DataFrame:
    """``key, doc_id, domain, lang, source, n_tokens`` of every row; tokens are runs of anything but
    blanks and controls 9 to 13.  ``further`` columns follow."""
    named = lambda c: F.coalesce(c.cast("string"), F.lit(MISSING))
    return documents.select(
        row_key(documents).alias("key"),
        "doc_id",
        named(targets.domain).alias("domain"),
        named(F.col("lang")).alias("lang"),
        named(F.col("source")).alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"),
        *further,
    )


def share_out(nodes: DataFrame, parent: Sequence[str], name: str) -> DataFrame:
    """Give each node its part of ``budget`` (equal on all nodes of one ``parent``) as ``given``.

    ``nodes`` has ``weight`` and ``capacity``.  Ordered by capacity per weight, the first nodes are
    full as long as what they can hold is less than their part of what is left; the others share
    the rest by weight, rounded so that nothing is lost.
    """
    siblings = Window.partitionBy(*parent).orderBy("_ratio", name)
    before = siblings.rowsBetween(Window.unboundedPreceding, -1)
    after = siblings.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy(*parent)
    tokens = lambda c: c.cast("decimal(27,0)")
    weight = lambda c: c.cast("decimal(10,0)")
    left = tokens(F.col("budget") - F.col("_held"))
    ranked = (
        nodes.withColumn("_ratio", F.col("capacity").cast("double") / F.col("weight"))
        .withColumn("_held", F.coalesce(F.sum("capacity").over(before), F.lit(0)))
        .withColumn("_open", F.sum("weight").over(after))
        .withColumn("_full", tokens(F.col("capacity")) * weight(F.col("_open")) <= left * weight(F.col("weight")))
    )
    # Full nodes come first, so the first of the others knows what is left for all of them.
    shared = ranked.withColumn("_all", F.max(F.when(~F.col("_full"), F.col("_open"))).over(whole))
    rest = F.max(F.when(~F.col("_full") & (F.col("_open") == F.col("_all")), left)).over(whole)

    def part(weights: Column) -> Column:
        product, over = F.col("_rest") * weight(weights), weight(F.col("_all"))
        return ((product - product % over) / over).cast("long")

    upto = F.col("_all") - F.col("_open")
    given = F.when(F.col("_full"), F.col("capacity")).otherwise(part(upto + F.col("weight")) - part(upto))
    return (
        shared.withColumn("_rest", rest)
        .withColumn("given", given.cast("long"))
        .drop("_ratio", "_held", "_open", "_full", "_all", "_rest")
    )


def leaf_budgets(leaves: DataFrame, budget: int, targets: Targets) -> DataFrame:
    """``domain, lang, source, supply, given`` from leaves with ``supply`` tokens."""
    held = leaves.withColumn("capacity", F.col("supply") * targets.epochs)
    given = None
    for depth in range(1, len(LEVELS) + 1):
        own, parent = list(LEVELS[:depth]), list(LEVELS[: depth - 1])
        nodes = held.groupBy(*own).agg(F.sum("capacity").alias("capacity"))
        nodes = nodes.withColumn("weight", targets.weights[depth - 1].cast("long"))
        if given is None:
            nodes = nodes.withColumn("budget", F.lit(budget).cast("long"))
        else:
            nodes = nodes.join(given.select(*parent, F.col("given").alias("budget")), parent)
        given = share_out(nodes, parent, own[-1])
    return held.join(given.select(*LEVELS, "given"), list(LEVELS)).drop("capacity")


def _cuts(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    """Per leaf with a part of an epoch to give: ``prefix`` and ``left``.  Orders below the prefix are
    taken, orders that start with it are taken while fewer than ``left`` tokens precede them.

    Each round looks at the next digits of the orders that start with the prefix so far, so no
    group has more than 16 ** STEP rows until the prefix holds ``BOUNDARY_ROWS`` documents.
    """
    cuts = leaves.filter("left > 0").select("leaf", "left", F.lit("").alias("prefix"))
    digits = 0
    while digits < DIGITS:
        digits += STEP
        inside = rows.join(cuts, "leaf").filter(F.col("order").startswith(F.col("prefix")))
        sums = inside.groupBy("leaf", "left", F.substring("order", 1, digits).alias("part")).agg(
            F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")
        )
        earlier = Window.partitionBy("leaf").orderBy("part")
        sums = sums.withColumn("upto", F.sum("tokens").over(earlier)).filter("upto >= left")
        first = F.min(F.struct("part", "left", "upto", "tokens", "n")).alias("at")
        found = sums.groupBy("leaf").agg(first)
        cuts = stage(
            found.select(
                "leaf",
                (F.col("at.left") - F.col("at.upto") + F.col("at.tokens")).alias("left"),
                F.col("at.part").alias("prefix"),
                F.col("at.n").alias("n"),
            ),
            "cuts",
        )
        if (cuts.agg(F.max("n")).first()[0] or 0) <= BOUNDARY_ROWS:
            break
        cuts = cuts.drop("n")
    return cuts.select("leaf", "left", "prefix")


def choose(documents: DataFrame, targets: Targets, share: tuple[int, int]) -> DataFrame:
    """``key, doc_id, epoch, domain, lang, source, n_tokens`` of the selected rows, once per epoch.

    The budget is ``share`` (a fraction as two whole numbers) of all tokens.  A leaf's epochs count
    from 0.  In its last, partial epoch documents follow the order of a hash of seed, epoch and id,
    and the one with which the leaf reaches its tokens is the last.  Null domains, languages and
    sources form leaves of their own; rows without an id are ordered by a hash of their text.
    Null, blank and empty texts have no tokens: a leaf with nothing else gives nothing.  Rows that
    repeat an id are documents of their own.  An empty table gives an empty result.
    """
    rows = narrow(documents, targets).withColumn("leaf", F.xxhash64(*LEVELS))
    rows = stage(rows, "tokens")
    supply = rows.groupBy("leaf", *LEVELS).agg(F.sum("n_tokens").alias("supply"))
    leaves = stage(supply, "leaves")
    total = leaves.agg(F.sum("supply")).first()[0] or 0
    given = leaf_budgets(leaves, total * share[0] // share[1], targets)
    some = F.greatest("supply", F.lit(1))
    planned = stage(
        given.select(
            "leaf",
            F.floor(F.col("given") / some).cast("int").alias("whole"),
            (F.col("given") % some).alias("left"),
        ),
        "planned",
    )
    seeded = F.concat_ws(":", F.lit(str(targets.seed)), F.col("whole").cast("string"), "key")
    ordered = rows.join(planned.select("leaf", "whole"), "leaf").withColumn("order", F.md5(seeded))
    cuts = _cuts(ordered, planned)
    # Zero tokens never decide, so equal keys need only an order among themselves.
    cut = ordered.join(cuts, "leaf", "left")
    start = F.substring("order", 1, F.length("prefix"))
    at_cut = cut.filter(F.col("prefix").isNotNull() & (start == F.col("prefix")))
    queue = Window.partitionBy("leaf").orderBy("order", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    partly = at_cut.withColumn("ahead", F.coalesce(F.sum("n_tokens").over(queue), F.lit(0)))
    partly = partly.filter("ahead < left").withColumn("epoch", F.col("whole"))
    below = cut.filter(F.col("prefix").isNotNull() & (start < F.col("prefix"))).withColumn("epoch", F.col("whole"))
    wholly = ordered.filter("whole > 0").withColumn(
        "epoch", F.explode(F.sequence(F.lit(0), F.col("whole") - 1))
    )
    columns = ["key", "doc_id", "epoch", *LEVELS, "n_tokens"]
    return wholly.select(*columns).unionByName(below.select(*columns)).unionByName(partly.select(*columns))


def mix(documents: DataFrame, targets: Targets, share: tuple[int, int]) -> DataFrame:
    """The selected documents in all their columns, once per epoch, with ``epoch`` (a column of that
    name is replaced).

    Rows of one leaf that repeat an id stand next to each other in its order, the shorter first.
    Where a leaf reaches its tokens among them, only so many as it needs are taken: of equally long
    ones those of least hash over all columns.  At most one such group of a leaf is split.
    """
    group = ["key", *LEVELS, "n_tokens"]
    chosen = stage(choose(documents, targets, share).groupBy(*group, "epoch").agg(F.count("*").alias("taken")), "chosen")
    sizes = narrow(documents, targets).groupBy(*group).agg(F.count("*").alias("held"))
    # Groups of which an epoch takes a part have their rows numbered; all others need no order.
    split = chosen.join(sizes, group).filter("taken < held").select(*group, "epoch").distinct()
    wanted = chosen.join(split.withColumn("split", F.lit(True)), [*group, "epoch"], "left")
    wanted = stage(wanted.fillna(False, ["split"]), "wanted")
    rest = documents.drop("epoch")
    row = F.struct(*[F.col(c) for c in rest.columns]).alias("row")
    keyed = narrow(documents, targets, row)
    whole = keyed.join(wanted.filter("NOT split"), group).select("row", "epoch")
    queue = Window.partitionBy(*group, "epoch").orderBy(F.xxhash64("row"))
    partly = keyed.join(wanted.filter("split"), group).withColumn("at", F.row_number().over(queue))
    found = whole.unionByName(partly.filter("at <= taken").select("row", "epoch"))
    return found.select("row.*", "epoch")
