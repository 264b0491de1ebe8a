"""Text expressions: strip, decode, readability."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from doctriage import fixed

# Fixed value: the characters str.strip() removes.
_BLANK = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + (
    "\u2028\u2029\u202f\u205f\u3000"
)


def py_strip(text: Column) -> Column:
    """Strip Unicode white space at both ends; ``trim`` alone removes only spaces.  It costs what it
    strips: a pattern would be tried at every character of the text."""
    return F.btrim(text, F.lit(_BLANK))


def is_blank(text: Column) -> Column:
    return py_strip(text) == ""


def universal_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def decode_utf8(content: Column) -> Column:
    """Strict UTF-8: null when any byte sequence is invalid. A byte order mark is kept."""
    return F.try_validate_utf8(content.cast("string"))


def decode_text_file(content: Column) -> Column:
    """What a text-mode read followed by strip yields, or null for invalid UTF-8."""
    return py_strip(universal_newlines(decode_utf8(content)))


def is_readable(text: Column) -> Column:
    """True when the stripped text is long enough; null text is False."""
    return is_long_enough(py_strip(text))


def is_long_enough(stripped: Column, min_chars: int = fixed.MIN_READABLE_CHARS) -> Column:
    """The same test on text that is stripped already, in code points."""
    return F.coalesce(F.length(stripped) >= min_chars, F.lit(False))


def char_count(text: Column) -> Column:
    return F.length(text)


def preview(text: Column, chars: int = fixed.PREVIEW_CHARS) -> Column:
    return F.substring(text, 1, chars)
