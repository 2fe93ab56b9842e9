"""Writing rendered bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafledger.schema import require

FORMATS = ("text", "html", "markdown", "json")


class UnsupportedFormat(ValueError):
    """The output format is not one of ``FORMATS``."""


def output_format(name: str) -> str:
    lowered = name.lower()
    if lowered not in FORMATS:
        raise UnsupportedFormat(f"unsupported format: {name}")
    return lowered


def write_bundle(df: DataFrame, path: str, format: str = "text", mode: str = "errorifexists") -> None:
    """Write blocks in order: the part files, read by name, are the document.

    ``df`` has ``section, tree_key, block`` (see ``plans.bundle``), or any
    columns for ``json``.  The sort is a range partitioning, so the parts are
    written in parallel.
    """
    kind = output_format(format)
    keys = [c for c in ("section", "tree_key") if c in df.columns]
    ordered = df.orderBy(*keys) if keys else df
    if kind == "json":
        ordered.drop("tree_key").write.mode(mode).json(path)
        return
    # The writer ends every block with a newline of its own.
    block = F.regexp_replace(F.col("block"), "\\n\\z", "")
    require(ordered, "block").select(block.alias("value")).write.mode(mode).text(path)
