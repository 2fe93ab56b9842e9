"""Project checks: expected files, large files, empty directories, binaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafledger.functions import paths as P
from leafledger.functions import sniff
from leafledger.functions.sizes import parse_size
from leafledger.functions.text import megabytes
from leafledger.schema import bytes_of, require

# Names that count, and the default threshold.
READMES = ("README.md", "readme.md")
LICENSES = ("LICENSE", "license")
IGNORE_FILE = ".gitignore"
TEST_DIRS = ("tests", "test")
TEST_SUFFIX = "_test.go"
LARGE_FILE = "10MB"


def _project(path: Column, by_top: bool) -> tuple[Column, Column]:
    """Project key and the path inside the project; a file at the root has no project."""
    if not by_top:
        return F.lit(""), path
    top = P.top_component(path)
    return top, F.substring(path, F.length(top) + 2, F.length(path))


def _in_projects(rows: DataFrame, by_top: bool) -> DataFrame:
    """Without the files that lie beside the project directories."""
    return rows.where("is_dir OR inside <> ''") if by_top else rows


def _check_columns(path: Column, is_dir: Column) -> dict[str, Column]:
    file = ~is_dir
    return {
        "has_readme": F.bool_or(file & path.isin(*READMES)),
        "has_license": F.bool_or(file & path.isin(*LICENSES)),
        "has_gitignore": F.bool_or(file & (path == IGNORE_FILE)),
        "has_tests": F.bool_or(is_dir & path.isin(*TEST_DIRS)),
        "has_test_files": F.bool_or(file & F.endswith(path, F.lit(TEST_SUFFIX))),
    }


def presence_checks(entries: DataFrame, by_top: bool = False) -> DataFrame:
    """Which expected files exist; ``by_top`` treats each top directory as a project."""
    project, inside = _project(F.col("relpath"), by_top)
    rows = require(entries, "relpath", "is_dir").select(
        project.alias("project"), inside.alias("inside"), "is_dir"
    )
    rows = _in_projects(rows, by_top)
    checks = _check_columns(F.col("inside"), F.col("is_dir"))
    flags = [F.coalesce(c, F.lit(False)).alias(n) for n, c in checks.items()]
    return rows.groupBy("project").agg(*flags) if by_top else rows.agg(*flags)


def large_files(corpus: DataFrame, threshold: str | int = LARGE_FILE) -> DataFrame:
    """Files above the threshold, with the size spelled out."""
    size = F.col("size_bytes")
    return require(corpus, "relpath", "size_bytes").where(size > parse_size(threshold)).select(
        "relpath",
        "size_bytes",
        F.concat("relpath", F.lit(" ("), megabytes(size, 2), F.lit("MB)")).alias("label"),
    )


def empty_directories(entries: DataFrame) -> DataFrame:
    """Directories that are no entry's parent.

    Parents are made distinct before the join, so a directory with a third of
    all entries is one key.  A directory with a ``warning`` could not be listed, so it is
    not known to be empty.
    """
    parents = require(entries, "relpath", "parent", "is_dir").select(
        F.col("parent").alias("relpath")
    ).distinct()
    folders = entries.where("is_dir")
    if "warning" in entries.columns:
        folders = folders.where("warning is null")
    return folders.select("relpath").join(parents, "relpath", "left_anti")


def health_check(
    corpus: DataFrame,
    entries: DataFrame,
    threshold: str | int = LARGE_FILE,
    by_top: bool = False,
) -> DataFrame:
    """Checks, counts and ordered warnings, one row per project.

    Entries, files and empty directories are laid end to end as narrow rows and
    summed in a single aggregation.  The lists behind the counts are
    ``large_files`` and ``empty_directories``.  ``corpus`` may be facts, whose
    ``is_binary`` is used.
    """
    path = F.col("relpath")
    no, none = F.lit(False), F.lit(0)
    known = "is_binary" in corpus.columns
    is_binary = F.col("is_binary") if known else sniff.has_nul(bytes_of(corpus))
    seen = entries.select(
        "relpath", "is_dir", none.alias("large"), none.alias("binary"), none.alias("empty")
    )
    measured = corpus.select(
        "relpath",
        no.alias("is_dir"),
        (F.col("size_bytes") > parse_size(threshold)).cast("int").alias("large"),
        is_binary.cast("int").alias("binary"),
        none.alias("empty"),
    )
    empty = empty_directories(entries).select(
        "relpath", F.lit(True).alias("is_dir"), none.alias("large"), none.alias("binary"),
        F.lit(1).alias("empty"),
    )
    project, inside = _project(path, by_top)
    rows = seen.unionByName(measured).unionByName(empty).select(
        project.alias("project"), inside.alias("inside"), "is_dir", "large", "binary", "empty"
    )
    rows = _in_projects(rows, by_top)
    checks = _check_columns(F.col("inside"), F.col("is_dir"))
    aggregates = [
        *[F.coalesce(c, no).alias(n) for n, c in checks.items()],
        F.coalesce(F.sum("large"), none).cast("long").alias("large_files"),
        F.coalesce(F.sum("empty"), none).cast("long").alias("empty_directories"),
        F.coalesce(F.sum("binary"), none).cast("long").alias("binary_files"),
    ]
    summed = rows.groupBy("project").agg(*aggregates) if by_top else rows.agg(*aggregates)
    return summed.withColumn("warnings", _warnings())


def _warnings() -> Column:
    """The texts, in this order."""

    def counted(column: str, before: str, after: str = "") -> Column:
        text = F.concat(F.lit(before), F.col(column).cast("string"), F.lit(after))
        return F.when(F.col(column) > 0, text)

    return F.array_compact(
        F.array(
            F.when(~F.col("has_readme"), "No README.md file found"),
            F.when(~F.col("has_license"), "No LICENSE file found"),
            F.when(~F.col("has_gitignore"), "No .gitignore file found"),
            F.when(~(F.col("has_tests") | F.col("has_test_files")), "No tests found"),
            counted("large_files", "Large files detected: "),
            counted("empty_directories", "Empty directories: "),
            counted("binary_files", "Binary files: ", " (consider adding to .gitignore)"),
        )
    )
