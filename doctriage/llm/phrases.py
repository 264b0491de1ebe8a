"""Prefix-free parsing: texts cut into phrases where a rolling hash fires, and the corpus order.

A phrase runs from one trigger to the end of the next one, so no phrase is the beginning of another
and texts that agree over a stretch are cut alike inside of it.  Sorting the suffixes of the distinct
phrases (the dictionary) and the suffixes of the phrase sequence (the parse) gives the order of all
suffixes of the texts: first by the rest of the own phrase, then by the phrases that follow.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

WORD = np.uint64
MIX_A, MIX_B = WORD(0xBF58476D1CE4E5B9), WORD(0x94D049BB133111EB)
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
PLACE_BITS = 24
PIECE_BYTES = 1 << 20


@dataclass(frozen=True)
class Parsing:
    """Strings of ``length`` bytes that occur again count as repeats.

    A trigger is a run of ``trigger`` bytes whose hash is 0 modulo ``modulus``.  A string stands
    under the trigger of least hash among those that begin in its first ``reach`` bytes.
    """

    length: int = 200
    trigger: int = 12
    modulus: int = 16
    reach: int = 100

    def __post_init__(self):
        if self.reach - 1 + self.trigger > self.length:
            raise ValueError("a trigger within reach must lie inside the string")

    @property
    def inner(self) -> int:
        """Bytes from a trigger on that every string under it contains."""
        return self.length - self.reach + 1


def _mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> WORD(30))) * MIX_A
    values = (values ^ (values >> WORD(27))) * MIX_B
    return values ^ (values >> WORD(31))


@lru_cache(1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, and a random number for each byte."""
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        powers = np.full(size, base, WORD)
        powers[0] = 1
        out.append(np.multiply.accumulate(powers))
    return *out, np.random.default_rng(29).integers(1, 1 << 63, 256, dtype=WORD)


class Rolling:
    """Hashes of substrings of ``data`` from one running sum."""

    def __init__(self, data: np.ndarray):
        size = max(1 << 16, 1 << (len(data)).bit_length())
        powers, self.inverse, values = _powers(size)
        self.sums = np.zeros(len(data) + 1, WORD)
        np.cumsum(values[data] * powers[: len(data)], out=self.sums[1:])

    def every(self, width: int) -> np.ndarray:
        """The hash of each substring of ``width`` bytes."""
        count = max(0, len(self.sums) - width)
        return _mix((self.sums[width:] - self.sums[:count]) * self.inverse[:count])

    def at(self, starts: np.ndarray, width: int) -> np.ndarray:
        return _mix((self.sums[starts + width] - self.sums[starts]) * self.inverse[starts])


def _least_within(keys: np.ndarray, reach: int) -> np.ndarray:
    """The smallest of ``reach`` adjoining keys, from each place on that has so many."""
    count = len(keys) - reach + 1
    if count <= 0:
        return keys[:0]
    padded = np.concatenate([keys, np.full(-len(keys) % reach, ~WORD(0))]).reshape(-1, reach)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:count], ahead[reach - 1 : reach - 1 + count])


def _triggered(data: np.ndarray, ends: np.ndarray, parsing: Parsing) -> tuple:
    """The runs of ``stretches`` as ``first, count``, the place of each one's trigger, and the hashes."""
    nothing = np.empty(0, np.int64)
    if len(data) < parsing.length:
        return nothing, nothing, nothing, None
    rolling = Rolling(data)
    keys = rolling.every(parsing.trigger)
    places = np.arange(len(keys), dtype=WORD)
    quiet = (keys % WORD(parsing.modulus) != 0).astype(WORD) << WORD(63)
    keys = ((keys >> WORD(1)) | quiet) >> WORD(PLACE_BITS) << WORD(PLACE_BITS) | places
    under = _least_within(keys, parsing.reach)[: len(data) - parsing.length + 1]
    under = (under & WORD((1 << PLACE_BITS) - 1)).astype(np.int64)
    lengths = np.diff(ends, prepend=0)
    end_of = np.repeat(ends, lengths)[: len(under)]
    starts = np.flatnonzero(np.arange(len(under)) + parsing.length <= end_of)
    if not len(starts):
        return nothing, nothing, nothing, None
    under, text = under[starts], end_of[starts]
    new = np.flatnonzero(np.r_[True, (under[1:] != under[:-1]) | (text[1:] != text[:-1])])
    return starts[new], np.diff(np.r_[new, len(starts)]), under[new], rolling


def stretches(data: np.ndarray, ends: np.ndarray, parsing: Parsing) -> tuple[np.ndarray, ...]:
    """The string starts of joined texts, as runs under one trigger: ``first, count, inner``.

    ``ends`` are the ends of the texts; strings stay inside their text.  Where no trigger is within
    reach, the least hash of all places stands in for it.  Equal strings stand under the same place
    of theirs, so the ``inner`` hashes of their runs are equal.
    """
    first, count, under, rolling = _triggered(data, ends, parsing)
    return first, count, rolling.at(under, parsing.inner) if len(first) else under


def leads(texts: list[bytes], parsing: Parsing) -> list[int]:
    """Where the trigger stands in each of ``texts`` that hold one run of strings and nothing else."""
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    first, _, under, _ = _triggered(np.frombuffer(b"".join(texts), np.uint8), ends, parsing)
    return (under - first).tolist()


def _refined(ranks: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Dense ranks of pairs, from 1."""
    pairs = ranks.astype(np.int64) * (int(following.max(initial=0)) + 1) + following
    return np.unique(pairs, return_inverse=True)[1] + 1


def _doubled(ranks: np.ndarray, ends: np.ndarray, step: int) -> np.ndarray:
    """Ranks of suffixes up to ``ends`` from ranks of their first ``step`` items; an end is least."""
    places = np.arange(len(ranks))
    longest = int((ends - places).max(initial=0))
    while step < longest and ranks.max(initial=0) < len(ranks):
        later = places + step
        inside = later < ends
        following = np.where(inside, ranks[np.where(inside, later, 0)], 0)
        ranks = _refined(ranks, following)
        step *= 2
    return ranks


def dictionary_order(phrases: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``offsets, ranks``: where each phrase begins in their joined text, and the rank of the rest
    of its phrase from each place on; equal rests have equal ranks, an end is least."""
    sizes = np.fromiter(map(len, phrases), np.int64, len(phrases))
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(phrases) + bytes(8), np.uint8)
    end_of = np.repeat(ends, sizes)
    left = np.minimum(end_of - np.arange(len(end_of)), 8)
    words = np.zeros(len(end_of), WORD)
    for at in range(8):
        byte = np.where(at < left, data[at : at + len(words)], 0).astype(WORD)
        words = words << WORD(8) | byte
    # Zeros behind an end look like zero bytes; what is left tells them apart.
    ranks = _refined(np.unique(words, return_inverse=True)[1], left)
    return ends - sizes, _doubled(ranks, end_of, 8)


def parse_order(ranks: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The rank of each suffix of the phrase sequences; a sequence's end is least."""
    ends = np.repeat(np.cumsum(counts), counts)
    return _doubled(ranks, ends, 1)


def _same(data: np.ndarray, left: np.ndarray, right: np.ndarray, length: int) -> np.ndarray:
    """Whether the strings of ``length`` bytes at paired places are equal, byte by byte."""
    found, width = np.arange(len(left)), min(8, length)
    # Eight bytes from each place on as one number.
    words = np.ndarray(len(data) - width + 1, "<u8" if width == 8 else f"V{width}", data, strides=(1,))
    for at in [*range(0, length - width, width), length - width]:
        found = found[words[left[found] + at] == words[right[found] + at]]
    out = np.zeros(len(left), bool)
    out[found] = True
    return out


def repeated_starts(texts: list[bytes], counts: np.ndarray, parsing: Parsing) -> np.ndarray:
    """Which strings occur again, for the first ``counts`` starts of each text, joined.

    All of these strings must lie inside their texts.  Their suffixes are put in corpus order;
    equal strings are neighbours there.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    begins = ends - sizes
    fires = np.flatnonzero(Rolling(data).every(parsing.trigger) % WORD(parsing.modulus) == 0)
    text_of = np.searchsorted(ends, fires, "right")
    fires = fires[fires + parsing.trigger <= ends[text_of]]
    cuts = np.union1d(begins, fires)
    text_of = np.searchsorted(ends, cuts, "right")
    last = np.r_[text_of[1:] != text_of[:-1], True]
    stops = np.where(last, ends[text_of], np.r_[cuts[1:], 0] + parsing.trigger)
    raw = data.tobytes()
    phrases = [raw[a:b] for a, b in zip(cuts.tolist(), stops.tolist())]
    distinct = {phrase: rank for rank, phrase in enumerate(sorted(set(phrases)), 1)}
    ranks = np.fromiter(map(distinct.__getitem__, phrases), np.int64, len(phrases))
    following = np.where(last, 0, np.r_[parse_order(ranks, np.bincount(text_of, minlength=len(texts)))[1:], 0])

    starts = np.repeat(begins - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())
    own = np.searchsorted(cuts, starts, "right") - 1
    # Only phrases in which a string starts need an order of their suffixes.
    needed = np.unique(ranks[own])
    by_rank = list(distinct)
    offsets, rests = dictionary_order([by_rank[rank - 1] for rank in needed.tolist()])
    rest = rests[offsets[np.searchsorted(needed, ranks[own])] + starts - cuts[own]]
    order = np.lexsort((following[own], rest))
    equal = _same(data, starts[order[:-1]], starts[order[1:]], parsing.length)
    out = np.zeros(len(starts), bool)
    out[order[:-1]] |= equal
    out[order[1:]] |= equal
    return out
