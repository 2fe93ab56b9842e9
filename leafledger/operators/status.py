"""Change status of files, from a tracked list and a table of two-letter codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafledger.functions.lookups import STATUS_TEXT, map_column
from leafledger.functions.text import strip
from leafledger.schema import require

UNKNOWN, UNCHANGED = "Unknown status", "Unchanged"


def parse_porcelain(lines: DataFrame, column: str = "value") -> DataFrame:
    """``XY path`` lines as ``(path, xy)``; both letters of the code are kept."""
    line = F.col(column)
    return require(lines, column).where(line != "").select(
        strip(F.expr(f"substr({column}, 4)")).alias("path"), F.left(line, F.lit(2)).alias("xy")
    )


def status_decode(code: Column) -> Column:
    return F.coalesce(F.try_element_at(map_column(STATUS_TEXT), code), F.lit(UNKNOWN))


def file_status(tracked: DataFrame, status: DataFrame) -> DataFrame:
    """Every tracked path and every path with a code.

    A tracked path is modified if its code holds M, D or R; anything whose
    first letter is neither blank nor ``?`` is staged.
    """
    listed = require(tracked, "path").select("path", F.lit(True).alias("tracked"))
    joined = listed.join(require(status, "path", "xy").select("path", "xy"), "path", "full_outer")
    code = F.col("xy")
    is_tracked = F.coalesce(F.col("tracked"), F.lit(False))
    return joined.select(
        "path",
        F.coalesce(code, F.lit("")).alias("status_code"),
        F.when(code.isNull(), UNCHANGED).otherwise(status_decode(code)).alias("status"),
        is_tracked.alias("tracked"),
        (is_tracked & F.coalesce(code.rlike("[MDR]"), F.lit(False))).alias("modified"),
        F.coalesce(code.rlike("\\A[^ ?]"), F.lit(False)).alias("staged"),
    )


def status_summary(statuses: DataFrame) -> DataFrame:
    return statuses.agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if("tracked").alias("tracked_files"),
        F.count_if(~F.col("tracked")).alias("untracked_files"),
        F.count_if("modified").alias("modified_files"),
        F.count_if("staged").alias("staged_files"),
    )


def changed_files(statuses: DataFrame) -> DataFrame:
    return statuses.where("status_code <> ''")
