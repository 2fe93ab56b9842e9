"""Column contracts checked when an operator is called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class MissingColumns(ValueError):
    """An operator was given a DataFrame without the columns it needs."""


def require(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise MissingColumns(f"missing columns {missing}; have {df.columns}")
    return df


def text_of(df: DataFrame) -> Column:
    """The payload as a string; bytes of a ``content`` column are kept as they are."""
    if "text" in df.columns:
        return F.col("text")
    require(df, "content")
    return F.col("content").cast("string")


def bytes_of(df: DataFrame) -> Column:
    """The payload as binary."""
    if "content" in df.columns:
        return F.col("content")
    require(df, "text")
    return F.col("text").cast("binary")
