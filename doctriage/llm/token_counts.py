"""Lengths in word pieces by a linear longest-match automaton, without building the pieces.

Pieces that start a word begin with a blank; the others continue one.  A word (with a blank in
front) is matched greedily, longest piece first.  The pieces form a trie; a node's failure link
leads to where matching goes on when its text cannot be extended, after popping the pieces that
the text before that point is cut into.  How many those are is computed once per node, so a word
costs one step per byte.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROOT, NOWHERE = 0, -1
MEMO_WORDS, MEMO_LENGTH = 500_000, 64


def ranked_pieces(path: str) -> list[bytes]:
    """The pieces of a vocabulary file with a base64 piece and a rank per line."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


def listed_pieces(path: str, marker: str = "##") -> list[bytes]:
    """The pieces of a vocabulary file with one piece per line, continuations after ``marker``."""
    with open(path, encoding="utf-8") as lines:
        names = [line.rstrip("\n") for line in lines]
    return [
        (n.removeprefix(marker) if n.startswith(marker) else " " + n).encode() for n in names if n
    ]


@dataclass(frozen=True)
class Automaton:
    """``steps`` maps ``node * 256 + byte`` to the next node (as two arrays), ``links`` are the
    failure links and ``pops`` the pieces popped on taking them."""

    keys: np.ndarray
    nexts: np.ndarray
    links: np.ndarray
    pops: np.ndarray

    @classmethod
    def build(cls, pieces: Iterable[bytes]) -> Automaton:
        steps: dict[int, int] = {}
        ends = [False]
        parents = [(NOWHERE, 0)]
        for piece in pieces:
            node = ROOT
            for byte in piece:
                step = node << 8 | byte
                if step not in steps:
                    steps[step] = len(ends)
                    ends.append(False)
                    parents.append((node, byte))
                node = steps[step]
            if node != ROOT:
                ends[node] = True
        depth = [0] * len(ends)
        for node in range(1, len(ends)):  # a parent is always made before its children
            depth[node] = depth[parents[node][0]] + 1
        links, pops = [NOWHERE] * len(ends), [0] * len(ends)
        for node in sorted(range(1, len(ends)), key=depth.__getitem__):
            parent, byte = parents[node]
            if ends[node]:
                links[node], pops[node] = ROOT, 1
                continue
            at, popped = links[parent], pops[parent]
            while at != NOWHERE and (at << 8 | byte) not in steps:
                popped += pops[at]
                at = links[at]
            if at != NOWHERE:
                links[node], pops[node] = steps[at << 8 | byte], popped
        return cls(
            np.fromiter(steps.keys(), np.int64, len(steps)),
            np.fromiter(steps.values(), np.int32, len(steps)),
            np.array(links, np.int32),
            np.array(pops, np.int32),
        )


class PieceCounts(dict):
    """Pieces per word, remembered up to a bound.  A word that cannot be cut counts as one piece
    and is negative here."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.steps = dict(zip(automaton.keys.tolist(), automaton.nexts.tolist()))
        self.links, self.pops = automaton.links.tolist(), automaton.pops.tolist()

    def __missing__(self, word: str) -> int:
        found = self.count(b" " + word.encode("utf-8", "surrogatepass"))
        if len(word) <= MEMO_LENGTH:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = found
        return found

    def count(self, text: bytes) -> int:
        steps, links, pops = self.steps, self.links, self.pops
        node, popped = ROOT, 0
        for byte in text:
            while (after := steps.get(node << 8 | byte, NOWHERE)) == NOWHERE:
                if links[node] == NOWHERE:
                    return -1
                popped += pops[node]
                node = links[node]
            node = after
        while node != ROOT:
            if links[node] == NOWHERE:
                return -1
            popped += pops[node]
            node = links[node]
        return popped


def count_tokens(documents: DataFrame, pieces: Iterable[bytes]) -> DataFrame:
    """``doc_id, n_words, n_tokens, n_unknown`` for every row, over the whole text.

    Words are separated by white space.  A word that the pieces cannot cut is one unknown token.
    Null, empty and blank texts count nothing; null ids stay null, repeated rows are counted each,
    further columns are ignored.  The automaton that is broadcast is as large as the vocabulary.
    """
    shared = documents.sparkSession.sparkContext.broadcast(Automaton.build(pieces))

    @F.pandas_udf("n_words long, n_tokens long, n_unknown long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        memo = PieceCounts(shared.value)
        for texts in batches:
            rows = []
            for text in texts:
                counts = list(map(memo.__getitem__, (text or "").split()))
                unknown = sum(c < 0 for c in counts) if counts and min(counts) < 0 else 0
                rows.append((len(counts), sum(counts) + 2 * unknown, unknown))
            yield pd.DataFrame(rows, columns=["n_words", "n_tokens", "n_unknown"])

    counted = documents.select("doc_id", run(F.col("text")).alias("counts"))
    return counted.select("doc_id", "counts.*")
