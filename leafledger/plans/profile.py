"""The full profile of a corpus from one scan."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafledger.operators import health, profile as S
from leafledger.operators.paths import derive_entries


@dataclass
class Profile:
    """Statistics by name, over stored facts; ``release`` drops the stored rows."""

    tables: dict[str, DataFrame]
    stored: tuple[DataFrame, ...]

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def release(self) -> None:
        for df in self.stored:
            df.unpersist()


def profile(
    corpus: DataFrame,
    as_of: dt.datetime,
    entries: DataFrame | None = None,
    large: str | int = health.LARGE_FILE,
    top: int = 10,
) -> Profile:
    """Every statistic, lazily, over one set of narrow facts.

    Per-file facts hold no content.  They are kept on executors with disk
    behind memory; a lost executor only means that its share is computed again.
    Statistics other than the per-file lists read the condensed facts.
    """
    entries = derive_entries(corpus) if entries is None else entries
    rows = S.facts(corpus, as_of).persist(StorageLevel.MEMORY_AND_DISK)
    classes = S.condense(rows).persist(StorageLevel.MEMORY_AND_DISK)
    tables = {
        "basic_stats": S.basic_stats(classes),
        "directory_count": S.directory_count(entries),
        "average_file_size": S.average_file_size(classes),
        "extension_counts": S.extension_counts(classes, top),
        "size_distribution": S.size_distribution(classes),
        "mtime_distribution": S.mtime_distribution(classes),
        "complexity_totals": S.complexity_totals(classes),
        "language_metrics": S.language_metrics(classes),
        "complex_files": S.complex_files(rows),
        "language_stats": S.language_stats(classes),
        "language_extensions": S.language_extensions(classes),
        "top_languages": S.top_languages(classes, top),
        "presence_checks": health.presence_checks(entries),
        "large_files": health.large_files(rows, large),
        "empty_directories": health.empty_directories(entries),
        "health_check": health.health_check(rows, entries, large),
        "report": S.profile_report(classes),
    }
    return Profile(tables, (classes, rows))


def report(
    corpus: DataFrame, as_of: dt.datetime, entries: DataFrame | None = None, large: str | int = health.LARGE_FILE
) -> DataFrame:
    """The profile as one table, without storing anything.

    Beside the sums per class: the number of directories, and each finding of the health check
    as a row whose ``files`` is a count, or 1 for yes and 0 for no.
    """
    entries = derive_entries(corpus) if entries is None else entries
    sums = S.profile_report(S.condense(S.facts(corpus, as_of)))
    folders = S.directory_count(entries).select(
        F.lit("directories").alias("section"), F.lit("").alias("item"), F.col("total_directories").alias("files")
    )
    checks = health.health_check(corpus, entries, large).drop("warnings")
    pairs = [x for c in checks.columns for x in (F.lit(c), F.col(c).cast("long"))]
    findings = checks.select(F.stack(F.lit(len(checks.columns)), *pairs).alias("item", "files")).select(
        F.lit("health").alias("section"), "item", "files"
    )
    return sums.unionByName(folders.unionByName(findings), allowMissingColumns=True)
