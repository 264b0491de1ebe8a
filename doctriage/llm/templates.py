"""Benchmark decontamination by template windows.

Words become template tokens: numbers, names, units and quantities ("12kg") are replaced by typed
placeholders, all else is lower-cased without surrounding punctuation.  Windows of template tokens
are hashed; documents and benchmark items meet on equal hashes.  Matches on one alignment of a
document and an item are put together: the values in the placeholders must correspond one to one,
so a question asked again with other numbers or names is caught, while a passage that merely has
the same shape is not.  Windows of equal words may match too, however few of them are literal.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doctriage.session import stage

# Words that are replaced as units.
UNITS = frozenset(
    "g kg mg t lb lbs oz gram grams kilogram kilograms ton tons tonne tonnes pound pounds ounce ounces "
    "m km cm mm mi ft yd meter meters metre metres kilometer kilometers kilometre kilometres centimeter "
    "centimeters mile miles foot feet inch inches yard yards l ml liter liters litre litres gallon gallons "
    "s ms min mins h hr hrs second seconds minute minutes hour hours day days week weeks month months "
    "year years mph kph km/h m/s hz khz mhz ghz w kw kwh mw v volt volts watt watts amp amps joule joules "
    "calorie calories byte bytes kb mb gb tb degree degrees celsius fahrenheit percent % $ € £ usd eur gbp "
    "dollar dollars cent cents euro euros".split()
)

LITERAL, NUMBER, NAME, UNIT, QUANTITY, DROPPED = range(6)
KIND_HASHES = [xxhash.xxh3_64_intdigest(b"\0%d" % kind) for kind in range(6)]
NUMBER_FORM = re.compile(r"[$€£]?[+-]?\d+(?:[.,:/]\d+)*")
QUANTITY_FORM = re.compile(r"([+-]?\d+(?:[.,]\d+)*)([a-z/%€$£]+)")
EDGES = "\"'`.,;:!?()[]{}<>*_~|«»“”‘’…-–—#&"
SENTENCE_END = (".", "!", "?")
MEMO_WORDS = 500_000
FILTER_BITS = 20
OUT_ROWS = 5000


@dataclass(frozen=True)
class Rules:
    """Windows have ``width`` tokens, of which at least five in eight are literal.  A document holds
    an item if matching windows on one alignment cover ``covered`` of its tokens, or all of a
    shorter item.  If ``verbatim``, windows of equal words, whatever their case, match with any
    number of literal tokens; an item of fewer than ``shortest`` tokens is looked for only so, as a
    whole.  Values must correspond one to one over the whole alignment or, if ``stretches``, over
    windows that follow each other on it and cover as much.

    A window of more than ``common`` different items (as the instruction that opens them all) is no
    evidence for any of them: an item must be covered by its other windows or, if these hold too few
    of its tokens, be there as a whole."""

    width: int = 8
    covered: int = 13
    shortest: int = 4
    verbatim: bool = True
    stretches: bool = True
    common: int = 5

    def literal(self, width: int) -> int:
        return -(-width * 5 // 8)


# What the registered query and the pipeline look for.
WHOLE = Rules()


def token(word: str) -> tuple[int, str]:
    """Kind and value of one word, without its neighbours (so never a name)."""
    core = word.strip(EDGES).lower()
    if not core:
        return (UNIT, word) if word in UNITS else (DROPPED, "")
    if core[0].isalpha():
        return (UNIT if core in UNITS else LITERAL), core
    if NUMBER_FORM.fullmatch(core):
        return NUMBER, core
    if core in UNITS:
        return UNIT, core
    joined = QUANTITY_FORM.fullmatch(core)
    if joined and joined[2] in UNITS:
        return QUANTITY, core
    return LITERAL, core


def is_capitalised(word: str) -> bool:
    core = word.strip(EDGES)
    return len(core) > 1 and core[0].isupper() and core[1:].islower()


class Lexicon(dict):
    """Words by number, with what a template needs to know of each in arrays.

    In most corpora most of the different words are new ones, so a new word only joins lists, which
    ``settle`` moves to the arrays at once for all new words of a text."""

    FIELDS = (("hashes", np.uint64), ("words", np.uint64), ("kinds", np.int8), ("capital", bool), ("ends", bool))

    def __init__(self) -> None:
        super().__init__()
        self.values: list[str] = []
        self.settled = 0
        for name, kind in self.FIELDS:
            setattr(self, name, np.zeros(1 << 12, kind))
        self.new = tuple([] for _ in self.FIELDS)

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self.values)
        if word.isalpha():
            # Nothing to strip, no number, no end of a sentence.
            value, ends = word.lower(), False
            kind = UNIT if value in UNITS else LITERAL
            capital = kind == LITERAL and len(word) > 1 and word[0].isupper() and word[1:].islower()
        else:
            kind, value = token(word)
            capital = kind == LITERAL and is_capitalised(word)
            ends = word.rstrip("\"')]}»”’").endswith(SENTENCE_END)
        self.values.append(value)
        hashes, words, kinds, capitals, all_ends = self.new
        hashes.append(xxhash.xxh3_64_intdigest(value) if kind == LITERAL else KIND_HASHES[kind])
        words.append(xxhash.xxh3_64_intdigest("\1" + value.casefold()))
        kinds.append(kind)
        capitals.append(capital)
        all_ends.append(ends)
        return at

    def settle(self) -> None:
        count = len(self.values)
        if count == self.settled:
            return
        for (name, kind), new in zip(self.FIELDS, self.new):
            array = getattr(self, name)
            if count > len(array):
                array = np.concatenate([array, np.zeros(max(count, 2 * len(array)) - len(array), kind)])
                setattr(self, name, array)
            array[self.settled : count] = np.array(new, kind)
            new.clear()
        self.settled = count

    def trim(self) -> None:
        if len(self) > MEMO_WORDS:
            self.clear()
            self.values.clear()
            self.settled = 0


def _window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    count = len(hashes) - width + 1
    with np.errstate(over="ignore"):
        total = np.full(count, width, np.uint64)
        for at in range(width):
            total *= np.uint64(0x9E3779B97F4A7C15)
            total += hashes[at : at + count]
        total ^= total >> np.uint64(32)
        total *= np.uint64(0xD6E8FEB86659FD93)
        total ^= total >> np.uint64(32)
    return total


class Template:
    """The template of one text.  A capitalised word is a name unless it starts a sentence; the
    text itself starts one if ``starts``."""

    def __init__(self, text: str, lexicon: Lexicon, starts: bool = True):
        words = text.split()
        codes = np.fromiter(map(lexicon.__getitem__, words), np.int64, len(words))
        lexicon.settle()
        ends = lexicon.ends[codes]
        opens = np.concatenate([[starts], ends[:-1]]) if len(words) else np.zeros(0, bool)
        kinds = lexicon.kinds[codes].copy()
        kinds[lexicon.capital[codes] & ~opens] = NAME
        kept = kinds != DROPPED
        self.kinds, self.codes, self.lexicon = kinds[kept], codes[kept], lexicon
        self.hashes = lexicon.hashes[self.codes].copy()
        self.hashes[self.kinds == NAME] = KIND_HASHES[NAME]
        self.literal = np.concatenate([[0], np.cumsum(self.kinds == LITERAL)])

    def __len__(self) -> int:
        return len(self.kinds)

    def windows(self, width: int, rules: Rules) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of the windows with enough literal tokens."""
        count = len(self) - width + 1
        if count <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        total = _window_hashes(self.hashes, width)
        literal = self.literal[width:] - self.literal[:count]
        at = np.flatnonzero(literal >= rules.literal(width))
        return at, total[at]

    def verbatim(self, width: int) -> np.ndarray:
        """Hashes of all windows by their words, whatever their case."""
        if len(self) < width:
            return np.zeros(0, np.uint64)
        return _window_hashes(self.lexicon.words[self.codes], width)

    def slots(self, at: int, width: int) -> list[str]:
        part = slice(at, at + width)
        return [
            self.lexicon.values[code].casefold()
            for code, kind in zip(self.codes[part], self.kinds[part])
            if kind != LITERAL
        ]


def benchmark_windows(items: DataFrame, rules: Rules) -> DataFrame:
    """``window, item_id, item, same, item_at, width, item_tokens, item_slots`` of all items; ``item``
    numbers them and ``same`` is a hash of their words.

    A short item is one window of its own length.  As an item may stand inside a sentence of a
    document, its first word is taken both as the start of a sentence and as a name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lexicon, number = Lexicon(), TaskContext.get().partitionId() << 33
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lexicon.trim()
                seen, number = set(), number + 1
                for starts in (True, False):
                    template = Template(text or "", lexicon, starts)
                    if not len(template):
                        continue
                    width = min(rules.width, len(template))
                    same_words = xxhash.xxh3_64_intdigest(template.lexicon.words[template.codes].tobytes())
                    places, hashes = (x.tolist() for x in template.windows(width, rules))
                    if len(template) < rules.shortest:
                        places, hashes = [], []
                    if rules.verbatim:
                        same = template.verbatim(width).tolist()
                        places, hashes = places + list(range(len(same))), hashes + same
                    for at, window in zip(places, hashes):
                        if (at, window) not in seen:
                            seen.add((at, window))
                            rows.append(
                                (window, item, number, same_words, at, width, len(template), template.slots(at, width))
                            )
            yield _batch(rows, WINDOW_FIELDS)

    return items.select(F.col("item_id").cast("long"), "text").mapInArrow(run, WINDOWS)


def document_windows(
    docs: DataFrame, widths: list[int], filter_bits: np.ndarray, rules: Rules
) -> DataFrame:
    """The windows of ``docs`` (``doc_id, print, text``) that pass the filter.  Verbatim ones have
    null for their slots, as they have the values of the item."""
    shared = docs.sparkSession.sparkContext.broadcast(filter_bits)
    shift = np.uint64(64 - FILTER_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, bits = Lexicon(), shared.value
        rows: list[tuple] = []
        for batch in batches:
            columns = (batch.column(i).to_pylist() for i in range(3))
            for doc, print_, text in zip(*columns):
                lexicon.trim()
                template = Template(text or "", lexicon)
                for width in widths:
                    at, hashes = template.windows(width, rules)
                    passed = bits[hashes >> shift]
                    for place, window in zip(at[passed].tolist(), hashes[passed].tolist()):
                        rows.append((window, doc, print_, place, width, template.slots(place, width)))
                        if len(rows) >= OUT_ROWS:
                            yield _batch(rows, FOUND_FIELDS)
                            rows.clear()
                    if not rules.verbatim:
                        continue
                    hashes = template.verbatim(width)
                    at = np.flatnonzero(bits[hashes >> shift])
                    for place, window in zip(at.tolist(), hashes[at].tolist()):
                        rows.append((window, doc, print_, place, width, None))
                        if len(rows) >= OUT_ROWS:
                            yield _batch(rows, FOUND_FIELDS)
                            rows.clear()
        if rows:
            yield _batch(rows, FOUND_FIELDS)

    return docs.select("doc_id", "print", "text").mapInArrow(run, FOUND)


STRINGS = pa.list_(pa.string())
WINDOWS = "window long, item_id long, item long, same long, item_at int, width int, item_tokens int, item_slots array<string>"
WINDOW_FIELDS = (
    ("window", pa.uint64()), ("item_id", pa.int64()), ("item", pa.int64()), ("same", pa.uint64()),
    ("item_at", pa.int32()), ("width", pa.int32()), ("item_tokens", pa.int32()), ("item_slots", STRINGS),
)
FOUND = "window long, doc_id long, print long, doc_at int, width int, doc_slots array<string>"
FOUND_FIELDS = (
    ("window", pa.uint64()), ("doc_id", pa.int64()), ("print", pa.int64()), ("doc_at", pa.int32()),
    ("width", pa.int32()), ("doc_slots", STRINGS),
)
HELD = "doc_id long, print long, item_id long, covered int, changed int, slots int"
HELD_FIELDS = (
    ("doc_id", pa.int64()), ("print", pa.int64()), ("item_id", pa.int64()), ("covered", pa.int32()),
    ("changed", pa.int32()), ("slots", pa.int32()),
)


def _batch(rows: list[tuple], fields: tuple) -> pa.RecordBatch:
    made = {}
    for at, (name, kind) in enumerate(fields):
        values = pa.array([r[at] for r in rows], kind)
        made[name] = values.view(pa.int64()) if kind == pa.uint64() else values
    return pa.RecordBatch.from_pydict(made)


def one_to_one(pairs: Column) -> Column:
    """Whether item values and document values determine each other."""
    of_item = F.array_distinct(F.transform(pairs, lambda p: p["item"]))
    of_doc = F.array_distinct(F.transform(pairs, lambda p: p["doc"]))
    return (F.size(of_item) == F.size(pairs)) & (F.size(of_doc) == F.size(pairs))


def longest_stretch(places: list[tuple[int, int, list[tuple[str, str]]]]) -> tuple[int, int, int]:
    """``covered, kept, slots`` of the best stretch of windows ``item_at, width, pairs`` of one
    alignment whose values determine each other; ``kept`` is minus the number of changed values.

    A stretch ends where a value clashes, and the next one starts as early as it can without it."""
    places = sorted(places, key=lambda p: p[:2])
    best, start, covered, end = (0, 0, 0), 0, 0, 0
    counts: Counter[tuple[str, str]] = Counter()
    of_item: dict[str, str] = {}
    of_doc: dict[str, str] = {}
    for at, (place, width, pairs) in enumerate(places):
        own = set(pairs)
        if len({i for i, _ in own}) < len(own) or len({d for _, d in own}) < len(own):
            # The window clashes with itself.
            start, covered, end = at + 1, 0, 0
            counts.clear(), of_item.clear(), of_doc.clear()
            continue
        while any(of_item.get(i, d) != d or of_doc.get(d, i) != i for i, d in own):
            first, size, gone = places[start]
            start += 1
            covered -= min(first + size, places[start][0] if start < at else first + size) - first
            for pair in set(gone):
                counts[pair] -= 1
                if not counts[pair]:
                    del counts[pair], of_item[pair[0]], of_doc[pair[1]]
        if start == at:
            covered, end = 0, 0
        for pair in own:
            counts[pair] += 1
            of_item[pair[0]], of_doc[pair[1]] = pair[1], pair[0]
        covered += max(0, place + width - max(place, end))
        end = max(end, place + width)
        best = max(best, (covered, -sum(i != d for i, d in counts), len(counts)))
    return best


def best_stretches(aligned: DataFrame) -> DataFrame:
    """``doc_id, print, item_id, covered, changed, slots`` of alignments with a long enough stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                windows = [
                    (w["item_at"], w["width"], [(p["item"], p["doc"]) for p in w["pairs"]])
                    for w in row["windows"]
                ]
                covered, kept, slots = longest_stretch(windows)
                if covered >= row["required"]:
                    rows.append((row["doc_id"], row["print"], row["item_id"], covered, -kept, slots))
            yield _batch(rows, HELD_FIELDS)

    narrow = aligned.select("doc_id", "print", "item_id", "required", "windows")
    return narrow.mapInArrow(run, HELD)


def _tokens(windows: Column) -> Column:
    """How many tokens of their item some windows cover."""
    places = F.transform(windows, lambda w: F.sequence(w["item_at"], w["item_at"] + w["width"] - 1))
    return F.size(F.array_distinct(F.flatten(places)))


def evidence(windows: DataFrame, rules: Rules) -> DataFrame:
    """The windows that count, each with ``required``, how many tokens of its item must be covered.

    An item's own windows count.  Where they hold fewer tokens than are required, all of its windows
    do, and the item must be there as a whole."""
    held = windows.groupBy("window", "width").agg(F.count_distinct("same").alias("texts"))
    tagged = windows.join(held, ["window", "width"]).withColumn("shared", F.col("texts") > rules.common)
    least = F.least(F.lit(rules.covered), F.col("item_tokens"))
    own = F.collect_set(F.when(~F.col("shared"), F.struct("item_at", "width"))).alias("own")
    # An item's windows are as many as its tokens.
    crowded = tagged.groupBy("item", "item_tokens").agg(own).filter(_tokens(F.col("own")) < least)
    marked = tagged.join(crowded.select("item", F.lit(True).alias("crowded")), "item", "left")
    marked = marked.fillna(False, ["crowded"]).filter("crowded OR NOT shared")
    required = F.when(F.col("crowded"), F.col("item_tokens")).otherwise(least)
    return marked.withColumn("required", required).drop("texts", "shared", "crowded")


def text_print(text: Column) -> Column:
    return F.xxhash64(text)


def leaks(documents: DataFrame, items: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``doc_id, print, item_id, covered, slots, changed`` for every document that holds an item.

    ``covered`` counts the item's tokens on the best consistent alignment, ``slots`` the different
    values in its placeholders and ``changed`` those the document has replaced.  ``print`` is a hash
    of the text, which tells rows without an id and versions under one id apart; rows that repeat
    both are reported once.  Null, empty and wordless texts hold nothing and are held by nothing; an
    item without an id is reported as null.  Further columns are ignored.
    """
    windows = stage(evidence(stage(benchmark_windows(items, rules), "item-windows"), rules), "windows")
    # Both lists have a bound: one entry per filter bucket, and one per width up to rules.width.
    bucket = F.shiftrightunsigned("window", 64 - FILTER_BITS).alias("bucket")
    buckets = windows.select(bucket).distinct().toPandas()["bucket"].to_numpy()
    widths = sorted(r["width"] for r in windows.select("width").distinct().collect())
    bits = np.zeros(1 << FILTER_BITS, bool)
    bits[buckets.astype(np.int64)] = True
    docs = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_print(F.col("text")).alias("print"), "text"
    ).filter("text IS NOT NULL")
    found = document_windows(docs, widths, bits, rules).distinct()
    doc_slots = F.coalesce("doc_slots", "item_slots")
    pairs = F.arrays_zip(F.col("item_slots").alias("item"), doc_slots.alias("doc"))
    matched = found.join(windows, ["window", "width"]).withColumn("pairs", pairs)
    # A group is no larger than its item.
    aligned = matched.groupBy(
        "doc_id", "print", "item", "item_id", "required", (F.col("doc_at") - F.col("item_at")).alias("shift")
    ).agg(
        F.collect_set(F.struct("item_at", "width", "pairs")).alias("windows")
    )
    aligned = aligned.withColumn("covered", _tokens(F.col("windows"))).filter("covered >= required")
    if rules.stretches:
        held = best_stretches(aligned)
    else:
        held = (
            aligned.withColumn("pairs", F.array_distinct(F.flatten("windows.pairs")))
            .withColumn("changed", F.size(F.filter("pairs", lambda p: p["item"] != p["doc"])))
            .filter(one_to_one(F.col("pairs")))
            .withColumn("slots", F.size("pairs"))
        )
    best = F.max(F.struct("covered", (-F.col("changed")).alias("kept"), "slots"))
    return (
        held.groupBy("doc_id", "print", "item_id")
        .agg(best.alias("best"))
        .select("doc_id", "print", "item_id", "best.covered", "best.slots", (-F.col("best.kept")).alias("changed"))
    )


def remove_leaks(documents: DataFrame, items: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``documents`` without those that hold a benchmark item, in all their columns."""
    flagged = leaks(documents, items, rules).select(
        F.col("doc_id").alias("_doc"), F.col("print").alias("_print")
    )
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_doc")) & (
        F.coalesce(text_print(F.col("text")), F.lit(0)) == F.col("_print")
    )
    return documents.join(flagged.distinct(), same, "left_anti").select(*documents.columns)
