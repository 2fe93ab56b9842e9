"""Cutting output to a byte budget.

The kept output is always a prefix of the tree order: a line that does not fit
stays in the sum, and every line has at least one byte.  So the cut is one
file and one line in it; finding it needs a running sum over narrow rows, and
applying it is a comparison of sort keys.  Content is not shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafledger.functions import paths as P
from leafledger.functions import text as TX
from leafledger.functions.sizes import parse_size
from leafledger.operators.lines import numbered as numbered_line
from leafledger.operators.running import running_total
from leafledger.schema import require, text_of


# The texts of both notes.


def truncated_message(limit: int) -> str:
    return f"[Output truncated: reached character limit of {limit}]"


def too_large_message(size: Column, limit: int) -> Column:
    bound = F.lit(limit).cast("long")
    return F.concat(
        F.lit("[File too large: "), TX.megabytes(size, 1),
        F.lit("MB - skipped (max: "), TX.megabytes(bound, 1), F.lit("MB)]"),
    )


def _too_large(max_file: str | int | None) -> Column:
    bound = parse_size(max_file)
    return F.col("size_bytes") > bound if bound > 0 else F.lit(False)


def too_large_rows(corpus: DataFrame, max_file: str | int | None = None) -> DataFrame:
    """The note that replaces a file above the size limit."""
    bound = parse_size(max_file)
    note = too_large_message(F.col("size_bytes"), bound)
    return require(corpus, "relpath", "size_bytes").where(_too_large(max_file)).select(
        "relpath", note.alias("message")
    )


def _lines_that_fit(lines: Column, room: Column, is_numbered: bool) -> Column:
    """How many leading lines fit into ``room`` bytes."""
    start = F.struct(F.lit(0).cast("long").alias("bytes"), F.lit(0).alias("seen"), F.lit(0).alias("kept"))

    def step(acc: Column, line: Column) -> Column:
        seen = acc["seen"] + 1
        number = F.greatest(F.length(seen.cast("string")), F.lit(2)) + 3 if is_numbered else F.lit(0)
        total = acc["bytes"] + F.octet_length(line) + 1 + number
        kept = F.when(total <= room, seen).otherwise(acc["kept"])
        return F.struct(total.cast("long").alias("bytes"), seen.alias("seen"), kept.alias("kept"))

    return F.aggregate(lines, start, step, lambda acc: acc["kept"])


def with_budget(
    corpus: DataFrame,
    limit: int,
    is_numbered: bool = True,
    max_file: str | int | None = None,
) -> DataFrame:
    """Add ``tree_key, too_large, line_count, kept_lines``.

    ``limit`` counts bytes of the written lines over all files in tree order;
    ``0`` means no limit.  Files above ``max_file`` take no room.
    """
    text = text_of(require(corpus, "relpath", "size_bytes"))
    sized = corpus.withColumns(
        {
            "tree_key": P.tree_key(F.col("relpath")),
            "too_large": _too_large(max_file),
            "line_count": TX.line_count(text),
        }
    )
    whole = F.when(F.col("too_large"), F.lit(0).cast("long")).otherwise(F.col("line_count"))
    if limit <= 0:
        return sized.withColumn("kept_lines", whole)
    written = TX.numbered_bytes(text) if is_numbered else TX.plain_bytes(text)
    narrow = sized.select(
        "tree_key", F.when(F.col("too_large"), F.lit(0)).otherwise(written).cast("long").alias("written")
    )
    ends = running_total(narrow, "written", ["tree_key"], name="end")
    cut = ends.where(F.col("end") > limit).agg(
        F.min(F.struct("tree_key", (F.col("end") - F.col("written")).alias("start"))).alias("cut")
    )
    at = F.col("__cut.tree_key")
    room = F.lit(limit) - F.col("__cut.start")
    partial = _lines_that_fit(TX.split_lines(text), room, is_numbered).cast("long")
    kept = (
        F.when(at.isNull() | (F.col("tree_key") < at), whole)
        .when(F.col("tree_key") > at, F.lit(0).cast("long"))
        .otherwise(partial)
    )
    return sized.withColumn("__cut", cut.scalar()).withColumn("kept_lines", kept).drop("__cut")


def budget_cut(
    corpus: DataFrame,
    limit: int,
    is_numbered: bool = True,
    max_file: str | int | None = None,
) -> DataFrame:
    """The lines that fit: ``relpath, tree_key, line_no, line`` as written."""
    kept = with_budget(corpus, limit, is_numbered, max_file).where("kept_lines > 0")
    lines = F.slice(TX.split_lines(text_of(corpus)), F.lit(1), F.col("kept_lines").cast("int"))
    rows = kept.select("relpath", "tree_key", F.posexplode(lines).alias("at", "raw"))
    style = "text" if is_numbered else None
    number = F.col("at") + 1
    return rows.select(
        "relpath", "tree_key", number.alias("line_no"), numbered_line(number, F.col("raw"), style).alias("line")
    )


def truncation_rows(
    corpus: DataFrame,
    limit: int,
    is_numbered: bool = True,
    max_file: str | int | None = None,
) -> DataFrame:
    """One note per file that lost lines to the budget."""
    cut = with_budget(corpus, limit, is_numbered, max_file)
    return cut.where(~F.col("too_large") & (F.col("kept_lines") < F.col("line_count"))).select(
        "relpath", F.lit(truncated_message(limit)).alias("message")
    )


def budget_by(
    df: DataFrame, limit: int, group: str, order: Sequence[str], size: Column
) -> DataFrame:
    """Rows of each group, in order, while their sizes add up to ``limit`` or less.

    Adds ``running``.  A group may be any share of the table: its running sum
    is cut into ranges.  ``group`` and ``order`` must identify a row.
    """
    summed = running_total(require(df, group, *order), size, order, within=[group])
    return summed if limit <= 0 else summed.where(F.col("running") <= limit)
