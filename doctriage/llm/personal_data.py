"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Only SQL functions are used.  Spark gives the matches of a pattern and the pieces of text between
them, but no positions; those are the running sums of both lengths.  Running values over an array
are taken in blocks of the square root of its size, so a text with very many matches costs no
quadratic time and no row leaves its place: nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Test = Callable[[Column], Column]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    """The Luhn checksum of a string of digits."""

    def part(i: Column) -> Column:
        digit = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = digit * 2
        return F.when(i % 2 == 0, digit).when(twice > 9, twice - 9).otherwise(twice)

    places = F.sequence(F.lit(0), F.length(digits) - 1)
    return F.aggregate(places, F.lit(0), lambda total, i: total + part(i)) % 10 == 0


def passes_mod97(match: Column) -> Column:
    """The ISO 7064 checksum of an account number: the first four characters moved to the end and
    letters read as 10 to 35, the rest modulo 97 is 1."""
    bare = F.regexp_replace(match, " ", "")
    turned = F.concat(F.substring(bare, 5, 64), F.substring(bare, 1, 4))

    def step(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(code < 58, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def _is_card(match: Column) -> Column:
    return let(digits_of(match), lambda d: F.length(d).between(12, 19) & passes_luhn(d))


PART = "0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


@dataclass(frozen=True)
class Kind:
    """``quick`` is passed by every text that holds a valid match.  ``pattern`` proposes, ``valid``
    confirms.  ``score`` in hundredths; 20 more with one of ``near`` in the context and 20 less
    with one of ``far``.  ``base`` kinds stay whatever their score."""

    name: str
    quick: str
    pattern: str
    valid: Test | None
    score: int
    near: str
    far: str = "example|sample|dummy"
    base: bool = True


# Patterns that could start anywhere in a run of characters begin only at the run's start or where
# the previous match ended, which finds the same matches in linear time.
KINDS = (
    Kind(
        "email",
        "@",
        r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        None,
        90,
        "mail|contact|write",
    ),
    Kind(
        "ip",
        r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]",
        r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
        lambda m: m.rlike(rf"^{PART}(\.{PART}){{3}}$"),
        60,
        r"\bip\b|address|host|server",
        r"version|release|\bv$",
    ),
    Kind(
        "card",
        "[0-9](?:[ -]?[0-9]){11}",
        "[0-9](?:[ -]?[0-9])++",
        _is_card,
        70,
        "card|visa|master|amex|credit|debit|pay",
        "order|invoice|tracking",
    ),
    Kind(
        "phone",
        r"\+[0-9]",
        r"\+[0-9][ ().0-9-]+[0-9]",
        lambda m: F.length(digits_of(m)).between(9, 15),
        70,
        "phone|tel|call|mobile|fax|whatsapp",
    ),
    Kind(
        "iban",
        "[A-Z]{2}[0-9]{2}",
        "[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)",
        passes_mod97,
        80,
        "iban|account|konto|bank",
        base=False,
    ),
    Kind(
        "ssn",
        "[0-9]{3}-[0-9]{2}-[0-9]{4}",
        "[0-9]{3}-[0-9]{2}-[0-9]{4}",
        lambda m: ~m.rlike("^(000|666|9)") & ~m.rlike("-00-|-0000$"),
        40,
        "ssn|social security|taxpayer",
        "order|invoice|part",
        base=False,
    ),
)
LEAST_SCORE = 50  # of spans that are not base spans
BEFORE, AFTER = 40, 20  # characters of context


def running(values: Column, start: int, merge: Callable[[Column, Column], Column]) -> Column:
    """For each element the merge of all earlier ones (``start`` for the first), in blocks."""

    def fold(part: Column) -> Column:
        return F.aggregate(part, F.lit(start), merge)

    def over(given: Column) -> Column:
        def blocks(block: Column) -> Column:
            each = F.transform(
                F.sequence(F.lit(1), F.size(given), block), lambda at: fold(F.slice(given, at, block))
            )
            return let(each, lambda sums: let(heads(sums), lambda known: all_of(known, block)))

        def heads(sums: Column) -> Column:
            return F.transform(sums, lambda _, b: fold(F.slice(sums, F.lit(1), b)))

        def all_of(known: Column, block: Column) -> Column:
            return F.transform(
                given,
                lambda _, i: merge(
                    F.get(known, F.floor(i / block).cast("int")),
                    fold(F.slice(given, i - i % block + 1, i % block)),
                ),
            )

        block = F.greatest(F.lit(1), F.floor(F.sqrt(F.size(given))).cast("int"))
        return F.when(F.size(given) > 0, let(block, blocks)).otherwise(F.array().cast("array<int>"))

    return let(values, over)


def spans_of(text: Column, kind: Kind, order: int) -> Column:
    """Confirmed spans of one kind: ``start, kind, end, score`` in code points, end exclusive."""
    nothing = F.array().cast("array<struct<start:int,kind:int,end:int,score:int>>")

    def score(before: Column, after: Column) -> Column:
        context = F.lower(F.concat(before, F.lit(" "), after))
        near = F.when(context.rlike(kind.near), 20).otherwise(0)
        far = F.when(context.rlike(kind.far), 20).otherwise(0)
        return F.greatest(F.lit(0), F.least(F.lit(100), F.lit(kind.score) + near - far))

    def located(pieces: Column, matches: Column) -> Column:
        # What lies between two starts: a match and the piece after it.
        steps = F.transform(
            F.sequence(F.lit(0), F.size(matches) - 1),
            lambda i: F.length(F.get(pieces, i)) + F.length(F.get(matches, i)),
        )
        return let(
            steps,
            lambda given: let(
                running(given, 0, lambda a, b: a + b),
                lambda heads: F.transform(
                    matches,
                    lambda m, i: F.struct(
                        (F.get(heads, i) + F.length(F.get(pieces, i))).alias("start"),
                        (F.get(heads, i) + F.get(given, i)).alias("end"),
                        F.lit(order).alias("kind"),
                        score(
                            F.substring(F.get(pieces, i), -BEFORE, BEFORE),
                            F.substring(F.get(pieces, i + 1), 1, AFTER),
                        ).alias("score"),
                        (F.lit(True) if kind.valid is None else kind.valid(m)).alias("valid"),
                    ),
                ),
            ),
        )

    def confirmed(matches: Column) -> Column:
        found = let(F.split(text, kind.pattern, -1), lambda pieces: located(pieces, matches))
        keeps = lambda s: s["valid"] & (F.lit(kind.base) | (s["score"] >= LEAST_SCORE))
        bare = lambda s: F.struct(s["start"], s["kind"], s["end"], s["score"])
        return F.when(F.size(matches) > 0, F.transform(F.filter(found, keeps), bare)).otherwise(nothing)

    quick = F.contains(text, F.lit("@")) if kind.quick == "@" else text.rlike(kind.quick)
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    return F.when(quick, let(matches, confirmed)).otherwise(nothing)


def all_spans(text: Column) -> Column:
    """Confirmed spans of all kinds by start, then kind as listed; spans of one kind never overlap."""
    return F.array_sort(F.concat(*[spans_of(text, kind, at) for at, kind in enumerate(KINDS)]))


def _joined(spans: Column, with_score: bool = False) -> Column:
    names = F.array(*[F.lit(kind.name) for kind in KINDS])

    def line(s: Column) -> Column:
        parts = [F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")]
        return F.concat_ws(":", *parts, *([s["score"].cast("string")] if with_score else []))

    return F.array_join(F.transform(spans, line), ",")


def find(documents: DataFrame) -> DataFrame:
    """``doc_id``, a count per kind, ``base_sha256``, ``spans`` and ``scored_spans`` for every row.

    Spans are ``kind:start:end`` in code points, end exclusive, by start and then kind; scored ones
    have the score in hundredths after them.  Base spans (email, ip, card, phone) always stay; the
    other kinds need a score of ``LEAST_SCORE``.  Null texts are empty ones: no span, and the hash
    of the empty string.  Repeated rows are treated alike, further columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found = documents.select("doc_id", all_spans(text).alias("found"))
    base = [at for at, kind in enumerate(KINDS) if kind.base]
    count = lambda at: F.size(F.filter("found", lambda s: s["kind"] == at)).cast("long")
    return found.select(
        "doc_id",
        *[count(at).alias(f"n_{kind.name}") for at, kind in enumerate(KINDS)],
        F.sha2(_joined(F.filter("found", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        _joined(F.col("found")).alias("spans"),
        _joined(F.col("found"), with_score=True).alias("scored_spans"),
    )


def blank_out(text: Column, spans: Column) -> Column:
    """``text`` with each span (or run of overlapping spans) replaced by its first kind: of
    spans that start together, the one listed first.

    The gaps are cut from segments of the text that cover a block of spans each.
    """
    tags = F.array(*[F.lit(f"[{kind.name.upper()}]") for kind in KINDS])

    def rebuilt(covered: Column) -> Column:  # the largest end of all earlier spans
        block = F.greatest(F.lit(1), F.floor(F.sqrt(F.size(spans))).cast("int"))

        def blocks(size: Column) -> Column:
            def piece(first: Column) -> Column:
                low = F.get(covered, first)
                last = F.least(first + size, F.size(spans)) - 1
                segment = F.substring(
                    text, low + 1, F.greatest(F.get(spans, last)["start"] - low, F.lit(0))
                )

                def parts(given: Column) -> Column:
                    def one(i: Column) -> Column:
                        span, free = F.get(spans, i), F.get(covered, i)
                        gap = F.substring(given, free - low + 1, F.greatest(span["start"] - free, F.lit(0)))
                        tag = F.when(span["start"] >= free, F.get(tags, span["kind"])).otherwise("")
                        return F.concat(gap, tag)

                    return F.array_join(F.transform(F.sequence(first, last), one), "")

                return let(segment, parts)

            firsts = F.sequence(F.lit(0), F.size(spans) - 1, size)
            return F.array_join(F.transform(firsts, piece), "")

        end = F.array_max(F.transform(spans, lambda s: s["end"]))
        return F.concat(let(block, blocks), F.substring(text, end + 1, F.length(text)))

    ends = F.transform(spans, lambda s: s["end"])
    body = let(running(ends, 0, lambda a, b: F.greatest(a, b)), rebuilt)
    return F.when(F.size(spans) > 0, body).otherwise(text)


def redact(documents: DataFrame) -> DataFrame:
    """``documents`` with personal data in ``text`` replaced by its kind in brackets; ``n_chars``, if
    there is one, follows the new text.  Null texts stay null, no row is dropped."""
    clean = F.when(
        F.col("text").isNotNull(), let(all_spans(F.col("text")), lambda s: blank_out(F.col("text"), s))
    )
    columns = [clean.alias("text") if c == "text" else F.col(c) for c in documents.columns]
    redacted = documents.select(*columns)
    if "n_chars" in documents.columns:
        kind = documents.schema["n_chars"].dataType
        length = F.coalesce(F.length("text").cast(kind), F.col("n_chars"))
        redacted = redacted.withColumn("n_chars", length)
    return redacted
