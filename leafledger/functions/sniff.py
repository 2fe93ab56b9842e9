"""Text-or-binary tests over all bytes of a file."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafledger.functions.lookups import TEXT_EXTENSIONS, one_of

VALID_SHARE = 0.8
CONTROL_SHARE = 0.3
REPLACEMENT = "\ufffd"

# Bytes below 32 that do not count as control characters are
# backspace, tab, newline, vertical tab, form feed and carriage return.
_CONTROL = "[\\x00-\\x07\\x0e-\\x1f]"


def has_nul(content: Column) -> Column:
    """A NUL byte anywhere; false for an empty file."""
    return F.contains(content, F.lit(b"\x00"))


def looks_textual(content: Column) -> Column:
    """The byte tests alone: no NUL, mostly valid UTF-8, few control bytes."""
    total = F.octet_length(content)
    as_text = content.cast("string")
    drop = lambda s: F.octet_length(F.replace(s, F.lit(REPLACEMENT)))
    # Repair turns each bad sequence into U+FFFD; those that were in the file
    # already are valid and are counted from the raw bytes.
    valid = F.when(F.is_valid_utf8(as_text), total).otherwise(
        drop(F.make_valid_utf8(as_text)) + total - drop(as_text)
    )
    controls = total - F.length(
        F.regexp_replace(F.decode(content, "ISO-8859-1"), _CONTROL, "")
    )
    return (
        ~has_nul(content)
        & (valid / total >= VALID_SHARE)
        & (controls / total <= CONTROL_SHARE)
    )


def is_text(ext_key: Column, content: Column) -> Column:
    """A known text extension decides; then emptiness; then the byte tests."""
    known = F.coalesce(one_of(ext_key, TEXT_EXTENSIONS), F.lit(False))
    return (
        F.when(known, True)
        .when(F.octet_length(content) == 0, True)
        .otherwise(looks_textual(content))
    )
