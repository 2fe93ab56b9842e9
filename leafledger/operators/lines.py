"""Line operators: splitting, counting, classifying, numbering, per-file metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafledger.functions import linecodes
from leafledger.functions import paths as P
from leafledger.functions import text as TX
from leafledger.operators.running import carried
from leafledger.schema import require, text_of

# Layouts of a numbered line.
LINE_STYLES = {"text": "%2d | %s", "markdown": "%d | %s"}


def split_lines(df: DataFrame) -> DataFrame:
    """A row per line: ``relpath, ext_key, line_no, line, line_too_long``."""
    text = text_of(require(df, "relpath"))
    return df.select(
        "relpath",
        P.extension_key(F.col("relpath")).alias("ext_key"),
        TX.has_long_line(text).alias("line_too_long"),
        F.posexplode(TX.split_lines(text)).alias("at", "line"),
    ).select("relpath", "ext_key", (F.col("at") + 1).alias("line_no"), "line", "line_too_long")


def line_count(df: DataFrame) -> DataFrame:
    """Add ``line_count`` without splitting the text."""
    return df.withColumn("line_count", TX.line_count(text_of(df)))


def classify_lines(df: DataFrame) -> DataFrame:
    """A row per line with its ``kind``, from files; nothing is shuffled."""
    text = text_of(require(df, "relpath"))
    ext_key = P.extension_key(F.col("relpath"))
    kinds = linecodes.kinds(linecodes.line_codes(ext_key, text))
    return (
        df.select(
            "relpath",
            ext_key.alias("ext_key"),
            F.posexplode(F.arrays_zip(TX.split_lines(text).alias("line"), kinds.alias("kind"))).alias(
                "at", "pair"
            ),
        )
        .where("pair.line is not null")
        .select("relpath", "ext_key", (F.col("at") + 1).alias("line_no"), "pair.line", "pair.kind")
    )


def classify_line_rows(lines: DataFrame) -> DataFrame:
    """Add ``kind`` to rows that are already one line each.

    The last line before this one that opens or closes a block decides whether
    it lies inside; it is carried over ranges of lines, so one file may span tasks.
    """
    require(lines, "relpath", "ext_key", "line_no", "line")
    syntax = linecodes.comment_syntax(F.col("ext_key"))
    prefix, start, end = syntax["prefix"], syntax["start"], syntax["end"]
    has_start = F.coalesce(F.contains("line", start), F.lit(False))
    has_end = F.coalesce(F.contains("line", end), F.lit(False))
    trimmed = TX.strip(F.col("line"))
    event = F.when(has_end, False).when(has_start, True)
    inside = F.coalesce(F.col("__inside"), F.lit(False))
    by_prefix = F.coalesce(F.startswith(trimmed, prefix), F.lit(False))
    return (
        carried(lines, event, ["line_no"], within=["relpath"], name="__inside")
        .withColumn(
            "kind",
            F.when(trimmed == "", "blank")
            .when(inside | has_start | by_prefix, "comment")
            .otherwise("code"),
        )
        .drop("__inside")
    )


def metric_columns(codes: Column) -> dict[str, Column]:
    """Counts of a file from its line codes."""
    return {
        "lines": F.length(codes).cast("long"),
        "code_lines": linecodes.count_letters(codes, linecodes.CODE),
        "blank_lines": linecodes.count_letters(codes, "b"),
        "comments": linecodes.count_letters(codes, linecodes.COMMENT),
        "complexity_score": linecodes.score(codes),
    }


def file_metrics(corpus: DataFrame) -> DataFrame:
    """Line counts and complexity per file that has an extension, lines of any length included."""
    text = text_of(require(corpus, "relpath"))
    ext_key = P.extension_key(F.col("relpath"))
    coded = corpus.where(ext_key.isNotNull()).select(
        "relpath", ext_key.alias("ext_key"), linecodes.line_codes(ext_key, text).alias("codes")
    )
    return coded.select(
        "relpath", "ext_key", *[c.alias(n) for n, c in metric_columns(F.col("codes")).items()]
    )


def numbered(line_no: Column, line: Column, style: str | None) -> Column:
    """One line in a style; ``None`` leaves it as it is."""
    return line if style is None else F.format_string(LINE_STYLES[style], line_no, line)


def number_lines(lines: DataFrame, style: str | None = "text") -> DataFrame:
    """Add ``numbered``."""
    require(lines, "line_no", "line")
    return lines.withColumn("numbered", numbered(F.col("line_no"), F.col("line"), style))
