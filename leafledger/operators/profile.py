"""Corpus statistics.

``facts`` turns each file into one narrow row of measures; ``condense`` adds
such rows up per class.  Every statistic accepts either, because both count
files by the sum of ``files``.  Columns a statistic does not use are never
computed: Catalyst drops them from the projection.
"""

from __future__ import annotations

import datetime as dt
import functools
from collections.abc import Callable, Collection

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafledger.functions import linecodes, sniff, tokens
from leafledger.functions import paths as P
from leafledger.functions.lookups import OTHER_LANGUAGE, language_table
from leafledger.operators.lines import metric_columns
from leafledger.schema import bytes_of, require, text_of

KB, MB = 1024, 1024 * 1024

# Size classes (upper bound exclusive) and age classes.
SIZE_BUCKETS = (
    ("0-1KB", KB),
    ("1KB-10KB", 10 * KB),
    ("10KB-100KB", 100 * KB),
    ("100KB-1MB", MB),
    ("1MB-10MB", 10 * MB),
    ("10MB+", None),
)
AGE_BUCKETS = (
    ("last_24_hours", 1),
    ("last_week", 7),
    ("last_month", 30),
    ("last_year", 365),
    ("older", None),
)
COMPLEX_LINES, COMPLEX_SCORE = 300, 20
LINE_MEASURES = ("lines", "code_lines", "blank_lines", "comments", "complexity_score", "complex_files")
MEASURES = ("files", "size_bytes", "tokens", "measured", *LINE_MEASURES)
CLASSES = ("ext", "size_bucket", "is_text", "is_binary")


def size_bucket(size: Column) -> Column:
    chosen = None
    for label, bound in SIZE_BUCKETS[:-1]:
        test = size < bound
        chosen = F.when(test, label) if chosen is None else chosen.when(test, label)
    return chosen.otherwise(SIZE_BUCKETS[-1][0])


def age_bucket(mtime: Column, as_of: dt.datetime) -> Column:
    """Age class at ``as_of``; a date in the future counts as new.

    ``as_of`` and a time without zone are read on one clock, whatever the driver's zone.  A
    time with a zone is first put on the session's clock, on which ``as_of`` then is.
    """
    chosen, local = None, mtime.cast("timestamp_ntz")
    for label, days in AGE_BUCKETS[:-1]:
        bound = (as_of - dt.timedelta(days=days)).isoformat(sep=" ")
        test = local > F.lit(bound).cast("timestamp_ntz")
        chosen = F.when(test, label) if chosen is None else chosen.when(test, label)
    return chosen.otherwise(AGE_BUCKETS[-1][0])


def _once(df: DataFrame, name: str, expensive: Column) -> DataFrame:
    """Add a column that filters above will read rather than compute again.

    Spark moves filters below projections by repeating the projected
    expressions in them; a generated column stops that.
    """
    return df.select("*", F.explode(F.array(expensive)).alias(name))


def facts(
    corpus: DataFrame, as_of: dt.datetime | None = None, with_lines: bool = True, only: Collection[str] | None = None
) -> DataFrame:
    """One narrow row per file; ``as_of`` adds ``age_bucket``.

    ``with_lines=False`` leaves out the line measures, whose one pass over the
    text would otherwise be made even where they are not used.  ``only`` names the columns
    wanted beside ``relpath`` and ``files`` (then without line measures): expressions that are not
    wanted are not even built, which is most of the planning of a simple statistic.
    """
    require(corpus, "relpath", "size_bytes")
    path = F.col("relpath")
    ext_key = P.extension_key(path)
    textual = functools.cache(lambda: sniff.is_text(ext_key, bytes_of(corpus)))
    makers: dict[str, Callable[[], Column]] = {
        "size_bytes": lambda: F.col("size_bytes"),
        "mtime": lambda: F.col("mtime"),
        "ext": lambda: P.extension(path),
        "ext_key": lambda: ext_key,
        "is_text": textual,
        "is_binary": lambda: sniff.has_nul(bytes_of(corpus)),
        "tokens": lambda: F.when(textual(), tokens.file_tokens(ext_key, text_of(corpus))).otherwise(0),
        "size_bucket": lambda: size_bucket(F.col("size_bytes")),
        "age_bucket": lambda: age_bucket(F.col("mtime"), as_of),
    }
    if "mtime" not in corpus.columns:
        del makers["mtime"]
    if as_of is None:
        del makers["age_bucket"]
    wanted = makers if only is None else [n for n in makers if n in only]
    columns = ["relpath", F.lit(1).cast("long").alias("files"), *[makers[n]().alias(n) for n in wanted]]
    if not with_lines or only is not None:
        return corpus.select(*columns)
    text = text_of(corpus)
    codes = linecodes.line_codes(ext_key, text)
    coded = _once(corpus, "codes", F.when(ext_key.isNotNull(), codes))
    return coded.select(
        *columns,
        F.col("codes").isNotNull().cast("long").alias("measured"),
        *[F.coalesce(c, F.lit(0)).alias(n) for n, c in metric_columns(F.col("codes")).items()],
    ).withColumn("complex_files", _is_complex().cast("long"))


def _is_complex() -> Column:
    return (F.col("measured") > 0) & ((F.col("lines") > COMPLEX_LINES) | (F.col("complexity_score") > COMPLEX_SCORE))


def condense(file_facts: DataFrame) -> DataFrame:
    """Facts summed per extension and class: as many rows as there are combinations."""
    classes = [c for c in (*CLASSES, "age_bucket") if c in file_facts.columns]
    sums = [F.sum(m).alias(m) for m in MEASURES if m in file_facts.columns]
    if "mtime" in file_facts.columns:
        sums += [F.min("mtime").alias("oldest"), F.max("mtime").alias("newest")]
    summed = file_facts.groupBy(*classes).agg(*sums)
    key = F.when(F.col("ext") != "", F.lower(F.substring_index("ext", ".", -1)))
    return summed.withColumn("ext_key", key)


def _total(column: str | Column) -> Column:
    return F.coalesce(F.sum(column), F.lit(0))


def _files_where(test: Column) -> Column:
    return _total(F.when(test, F.col("files")).otherwise(0))


def basic_stats(f: DataFrame) -> DataFrame:
    """Files, bytes, text and binary counts, tokens of the text files."""
    return f.agg(
        _total("files").alias("total_files"),
        _total("size_bytes").alias("total_size"),
        _files_where(F.col("is_text")).alias("text_files"),
        _files_where(~F.col("is_text")).alias("binary_files"),
        _total("tokens").alias("estimated_tokens"),
    )


def directory_count(entries: DataFrame) -> DataFrame:
    """Directories, the root included."""
    return entries.agg((F.count_if("is_dir") + 1).alias("total_directories"))


def average_file_size(f: DataFrame) -> DataFrame:
    mean = _total("size_bytes").cast("double") / F.nullif(_total("files"), F.lit(0))
    return f.agg(F.coalesce(mean, F.lit(0.0)).alias("average_file_size"))


def extension_counts(f: DataFrame, limit: int = 0) -> DataFrame:
    """Files and bytes per extension, most files first; ``limit`` keeps the top ones."""
    ranked = (
        f.where("ext <> ''")
        .groupBy(F.col("ext").alias("extension"))
        .agg(F.sum("files").alias("files"), F.sum("size_bytes").alias("size_bytes"))
        .orderBy(F.desc("files"), "extension")
    )
    return ranked.limit(limit) if limit > 0 else ranked


def size_distribution(f: DataFrame) -> DataFrame:
    """All six size classes, empty ones included: one aggregate row, turned on its side."""
    counts = f.agg(
        *[_files_where(F.col("size_bucket") == b).alias(f"b{i}") for i, (b, _) in enumerate(SIZE_BUCKETS)]
    )
    pairs = [x for i, (b, _) in enumerate(SIZE_BUCKETS) for x in (F.lit(b), F.col(f"b{i}"))]
    return counts.select(F.stack(F.lit(len(SIZE_BUCKETS)), *pairs).alias("bucket", "files"))


def mtime_distribution(f: DataFrame) -> DataFrame:
    """Files per age class, oldest and newest time; needs facts made with ``as_of``."""
    require(f, "age_bucket")
    low, high = ("mtime", "mtime") if "mtime" in f.columns else ("oldest", "newest")
    return f.agg(
        *[_files_where(F.col("age_bucket") == b).alias(b) for b, _ in AGE_BUCKETS],
        F.min(low).alias("oldest_file"),
        F.max(high).alias("newest_file"),
    )


def complexity_totals(f: DataFrame) -> DataFrame:
    """Line sums over measured files, with the share of code lines in percent."""
    share = F.sum("code_lines").cast("double") / F.nullif(F.sum("lines"), F.lit(0)) * 100
    return f.agg(
        _total("lines").alias("total_lines"),
        _total("code_lines").alias("code_lines"),
        _total("comments").alias("comment_lines"),
        _total("blank_lines").alias("blank_lines"),
        F.coalesce(share, F.lit(0.0)).alias("code_density"),
    )


def _with_share(grouped: DataFrame) -> DataFrame:
    """Add the share of all files in percent.

    The total is a scalar subquery over the same groups.  It sums every count
    of the group, used or not, so that it needs the same columns and Spark
    reuses the shuffle it has written instead of reading the corpus again.
    """
    counts = [c for c, kind in grouped.dtypes if kind == "bigint"]
    totals = grouped.agg(F.struct(*[F.sum(c).alias(c) for c in counts])).scalar()
    return grouped.withColumn(
        "percentage", F.col("files") / totals["files"].cast("double") * 100
    )


def language_metrics(f: DataFrame) -> DataFrame:
    """Line sums per lower-cased extension over measured files."""
    grouped = (
        require(f, "measured")
        .where("measured > 0")
        .groupBy("ext_key")
        .agg(
            F.sum("measured").alias("files"),
            *[F.sum(m).alias(m) for m in ("lines", "code_lines", "blank_lines", "comments")],
        )
    )
    return _with_share(grouped)


def complex_files(file_facts: DataFrame) -> DataFrame:
    """Files that are long or score high; needs one row per file."""
    return require(file_facts, "measured").where(_is_complex()).select("relpath", "lines", "complexity_score")


def language_extensions(f: DataFrame) -> DataFrame:
    """Files and bytes per language and extension: the long form, whole for any corpus.

    Files are summed per extension first, so the language table meets one row
    per extension.
    """
    per_ext = (
        f.where("ext_key is not null")
        .groupBy("ext_key")
        .agg(F.sum("files").alias("files"), F.sum("size_bytes").alias("size_bytes"))
    )
    named = per_ext.join(F.broadcast(language_table(f.sparkSession)), "ext_key", "left")
    return named.select(
        F.coalesce("language", F.lit(OTHER_LANGUAGE)).alias("language"),
        F.col("ext_key").alias("extension"),
        "files",
        "size_bytes",
    )


def language_stats(f: DataFrame) -> DataFrame:
    """Files, bytes, share and number of extensions per language; ``language_extensions`` has
    the extensions as rows."""
    counts = language_extensions(f).groupBy("language").agg(
        F.sum("files").alias("files"),
        F.sum("size_bytes").alias("size_bytes"),
        F.count("extension").alias("extension_count"),
    )
    # One row per language, 32 at most: one window is enough.
    everything = Window.partitionBy(F.lit(0))
    return counts.withColumn(
        "percentage", F.col("files") / F.sum("files").over(everything).cast("double") * 100
    )


def top_languages(f: DataFrame, limit: int = 0) -> DataFrame:
    ranked = language_stats(f).orderBy(F.desc("files"), "language")
    return ranked.limit(limit) if limit > 0 else ranked


def profile_report(condensed: DataFrame) -> DataFrame:
    """Sums per class as rows ``(section, item, measures, oldest, newest, percentage)``.

    Grouping sets over condensed facts: the corpus is scanned once, and the
    sets multiply only the condensed rows.  The share is that of all files.
    """
    require(condensed, "age_bucket")
    table = F.broadcast(language_table(condensed.sparkSession))
    named = condensed.join(table, "ext_key", "left").withColumn(
        "language",
        F.when(F.col("ext_key").isNotNull(), F.coalesce("language", F.lit(OTHER_LANGUAGE))).otherwise(""),
    ).withColumn("kind", F.when(F.col("is_text"), "text").otherwise("binary"))
    dims = ["ext", "language", "size_bucket", "age_bucket", "kind"]
    columns = [F.col(d) for d in dims]
    grouped = named.groupingSets([[c] for c in columns] + [[]], *columns).agg(
        *[F.grouping(d).alias(f"g_{d}") for d in dims],
        *[_total(m).alias(m) for m in MEASURES],
        F.min("oldest").alias("oldest"),
        F.max("newest").alias("newest"),
    )
    section, item = F.lit("total"), F.lit("")
    for d in dims:
        section = F.when(F.col(f"g_{d}") == 0, F.lit(d)).otherwise(section)
        item = F.when(F.col(f"g_{d}") == 0, F.col(d)).otherwise(item)
    rows = grouped.select(section.alias("section"), item.alias("item"), *MEASURES, "oldest", "newest")
    # The total is one of the few rows here: the largest count of files.
    everything = F.max("files").over(Window.partitionBy(F.lit(0)))
    share = F.col("files") / F.nullif(everything, F.lit(0)).cast("double") * 100
    return rows.withColumn("percentage", F.coalesce(share, F.lit(0.0)))
