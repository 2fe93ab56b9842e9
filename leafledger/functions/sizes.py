"""Byte sizes written as text: ``1024``, ``512B``, ``1KB``, ``10 MB``, ``1gb``."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafledger.functions.text import strip

# The accepted units.
UNIT_BYTES = {"B": 1, "KB": 1024, "MB": 1024**2, "GB": 1024**3}

LONG_MAX = 2**63 - 1


def parse_size(text: str | int | None) -> int:
    """Bytes of a size option; empty means 0, which callers read as no limit."""
    if isinstance(text, int):
        return text
    text = (text or "").strip()
    if not text:
        return 0
    found = re.fullmatch(r"([0-9]+)\s*([A-Za-z]*)", text)
    if not found:
        raise ValueError(f"invalid size value: {text!r}")
    number, unit = int(found[1]), found[2].upper() or "B"
    if unit not in UNIT_BYTES:
        raise ValueError(f"unknown size unit: {unit!r}")
    if number > LONG_MAX:
        raise ValueError(f"invalid size value: {text!r}")
    return number * UNIT_BYTES[unit]


def size_column(text: Column) -> Column:
    """``parse_size`` for a column: bytes, 0 for empty text, null where invalid."""
    trimmed = strip(text)
    digits = F.regexp_extract(trimmed, "^([0-9]+)\\s*([A-Za-z]*)\\z", 1)
    unit = F.upper(F.regexp_extract(trimmed, "^([0-9]+)\\s*([A-Za-z]*)\\z", 2))
    scale = F.when(unit == "", F.lit(1).cast("long"))
    for name, factor in UNIT_BYTES.items():
        scale = scale.when(unit == name, F.lit(factor).cast("long"))
    number = digits.try_cast("long")
    return F.when(trimmed == "", F.lit(0).cast("long")).otherwise(F.try_multiply(number, scale))
