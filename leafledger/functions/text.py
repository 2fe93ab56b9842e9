"""Line and whitespace expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode White_Space characters.
SPACES = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# A line of this many bytes or more is flagged.
LONG_LINE_BYTES = 65536


def strip(text: Column) -> Column:
    """Trim every kind of Unicode white space, not only blanks."""
    return F.btrim(text, F.lit(SPACES))


def count_of(text: Column, needle: str) -> Column:
    """Occurrences of a one-byte needle."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(needle)))


def split_lines(text: Column) -> Column:
    """Lines of a text: a final newline adds no line, one ``\\r`` before each end is dropped."""
    # Without its last newline the text splits into exactly its lines.
    body = F.when(
        F.endswith(text, F.lit("\n")), F.left(text, F.length(text) - 1)
    ).otherwise(text)
    plain = F.when(
        F.contains(body, F.lit("\r")),
        F.regexp_replace(F.replace(body, F.lit("\r\n"), F.lit("\n")), "\\r\\z", ""),
    ).otherwise(body)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(plain, "\n", -1))


def line_count(text: Column) -> Column:
    """Newlines, plus one if the last line has none."""
    open_end = F.when((text != "") & ~F.endswith(text, F.lit("\n")), 1).otherwise(0)
    return (count_of(text, "\n") + open_end).cast("long")


def has_long_line(text: Column) -> Column:
    """Some raw line (before ``\\r`` is dropped) has ``LONG_LINE_BYTES`` or more; only a flag."""
    return F.when(F.octet_length(text) < LONG_LINE_BYTES, F.lit(False)).otherwise(
        F.exists(F.split(text, "\n", -1), lambda s: F.octet_length(s) >= LONG_LINE_BYTES)
    )


def line_bytes(text: Column) -> Column:
    """Bytes of all lines together, without line ends."""
    dropped = F.when(
        F.contains(text, F.lit("\r")),
        (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\r\n"), F.lit("\n"))))
        + F.when(F.endswith(text, F.lit("\r")), 1).otherwise(0),
    ).otherwise(0)
    return (F.octet_length(text) - count_of(text, "\n") - dropped).cast("long")


def numbered_bytes(text: Column) -> Column:
    """Bytes of the lines written as ``%2d | line`` plus newline.

    The number takes two places up to 99 and one more at each power of ten, so
    the total follows from the line count without visiting the lines.
    """
    n = line_count(text)
    wider = sum(
        (F.greatest(n - (10**k - 1), F.lit(0)) for k in range(2, 10)), F.lit(0).cast("long")
    )
    return line_bytes(text) + n * 6 + wider


def plain_bytes(text: Column) -> Column:
    """Bytes of the lines written without numbers, newline included."""
    return line_bytes(text) + line_count(text)


def megabytes(size: Column, digits: int) -> Column:
    """``size`` in MiB with fixed digits, ties to even, in whole-number arithmetic.

    ``format_string`` rounds ties up, so 131072 bytes would print as 0.13.
    """
    scale, mib = 10**digits, 1 << 20
    scaled = size.cast("long") * scale
    rest = F.pmod(scaled, F.lit(mib))
    whole = F.shiftright(scaled, 20)
    up = (rest > mib // 2) | ((rest == mib // 2) & (F.pmod(whole, F.lit(2)) == 1))
    units = whole + F.when(up, 1).otherwise(0)
    fraction = F.lpad(F.pmod(units, F.lit(scale)).cast("string"), digits, "0")
    return F.concat(F.floor(units / scale).cast("string"), F.lit("."), fraction)


def escape_html(text: Column) -> Column:
    """The five entities, ampersand first."""
    for char, entity in (
        ("&", "&amp;"), ("'", "&#39;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"),
    ):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text
