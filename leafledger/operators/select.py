"""Selecting files by path, tracked set, ignore rules, size and content."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafledger.functions import paths as P
from leafledger.functions import sniff
from leafledger.functions.globs import comma_list, full_match
from leafledger.functions.sizes import parse_size, size_column
from leafledger.operators.ignore import ignored_paths, with_ignored
from leafledger.operators.spread import spread_join
from leafledger.schema import bytes_of, require


def _path() -> Column:
    return F.col("relpath")


# -- predicates --------------------------------------------------------------


def not_dotted(scope: str = "path") -> Column:
    """``path``: no component starts with a dot; ``base``: the file name does not."""
    if scope == "path":
        return ~P.is_dotted(_path())
    if scope == "base":
        return ~F.startswith(P.base_name(_path()), F.lit("."))
    raise ValueError(f"scope must be 'path' or 'base', not {scope!r}")


def has_extension(extensions: str | Iterable[str] | None) -> Column:
    """Case-sensitive membership; the dot is optional; no list admits all."""
    wanted = [e if e.startswith(".") else f".{e}" for e in comma_list(extensions)]
    return P.extension(_path()).isin(wanted) if wanted else F.lit(True)


def matches_glob(patterns: str | Iterable[str] | None) -> Column:
    """Some glob covers the base name or the whole path."""
    regexes = [r for r in map(full_match, comma_list(patterns)) if r is not None]
    if not regexes:
        return F.lit(False)
    either = "|".join(regexes)
    return P.base_name(_path()).rlike(either) | _path().rlike(either)


def within_size(limit: str | int | None) -> Column:
    """``size_bytes`` up to the limit; ``0`` and ``None`` mean none."""
    bound = parse_size(limit)
    return F.col("size_bytes") <= bound if bound > 0 else F.lit(True)


# -- single operators --------------------------------------------------------


def filter_dotfiles(df: DataFrame, scope: str = "path") -> DataFrame:
    return require(df, "relpath").where(not_dotted(scope))


def filter_extensions(df: DataFrame, extensions: str | Iterable[str] | None) -> DataFrame:
    return require(df, "relpath").where(has_extension(extensions))


def exclude_globs(df: DataFrame, patterns: str | Iterable[str] | None) -> DataFrame:
    return require(df, "relpath").where(~matches_glob(patterns))


def max_size(df: DataFrame, limit: str | int | None = None) -> DataFrame:
    return require(df, "size_bytes").where(within_size(limit))


def _tracked_paths(tracked: DataFrame) -> DataFrame:
    name = "relpath" if "relpath" in tracked.columns else "path"
    return require(tracked, name).select(F.col(name).alias("relpath"))


def tracked_only(df: DataFrame, tracked: DataFrame) -> DataFrame:
    """Files whose path is in ``tracked``; an empty set keeps every file.

    Emptiness is settled when the operator is called, by fetching one row, so
    that the plan is a plain semi join, for which Spark can broadcast a small
    set or prune by a runtime Bloom filter.
    """
    require(df, "relpath")
    paths = _tracked_paths(tracked)
    return df if paths.isEmpty() else df.join(paths, "relpath", "left_semi")


def quota_join(df: DataFrame, quotas: DataFrame, key: str) -> DataFrame:
    """Files within the size quota of their ``key``, with quotas given as text.

    ``quotas`` is ``(key, quota)``.  A key without a row, or with an invalid
    quota, imposes no limit; ``quota_bytes`` is null and ``quota_invalid`` tells
    the two apart.  The key is spread, since one source may own most files.
    """
    require(df, key, "size_bytes", "relpath")
    parsed = require(quotas, key, "quota").select(
        key,
        size_column(F.col("quota")).alias("quota_bytes"),
        size_column(F.col("quota")).isNull().alias("quota_invalid"),
    )
    joined = spread_join(df, parsed, [key], F.col("relpath"))
    limit = F.coalesce(F.col("quota_bytes"), F.lit(0))
    return joined.withColumn(
        "quota_invalid", F.coalesce(F.col("quota_invalid"), F.lit(False))
    ).where((limit <= 0) | (F.col("size_bytes") <= limit))


def classify_text(df: DataFrame) -> DataFrame:
    """Add ``is_text``."""
    return require(df, "relpath").withColumn(
        "is_text", sniff.is_text(P.extension_key(_path()), bytes_of(df))
    )


def nul_sniff(df: DataFrame) -> DataFrame:
    """Add ``is_binary``: a NUL anywhere."""
    return df.withColumn("is_binary", sniff.has_nul(bytes_of(df)))


# -- the composed selection --------------------------------------------------


@dataclass(frozen=True)
class Selection:
    """What to keep. Comma lists or iterables; empty fields restrict nothing."""

    extensions: str | Iterable[str] | None = None
    exclude: str | Iterable[str] | None = None
    include_dotfiles: bool = False
    tracked: DataFrame | None = field(default=None, compare=False)
    rules: DataFrame | None = field(default=None, compare=False)
    text_only: bool = True
    max_file_size: str | int | None = 0

    def path_predicate(self) -> Column:
        keep = ~matches_glob(self.exclude) & has_extension(self.extensions)
        return keep if self.include_dotfiles else not_dotted() & keep


def select_files(df: DataFrame, spec: Selection) -> DataFrame:
    """Files that pass every part of ``spec``.

    The path predicates come first and the content test last.  The tracked set and then the
    ignore rules meet narrow rows of the paths that are left; what they leave is one set of
    paths, and a single semi join takes it back to the content.
    """
    kept = require(df, "relpath").where(spec.path_predicate())
    kept = max_size(kept, spec.max_file_size) if parse_size(spec.max_file_size) > 0 else kept
    paths = kept.select("relpath")
    if spec.tracked is not None:
        paths = tracked_only(paths, spec.tracked)
    if spec.rules is not None:
        ignored = ignored_paths(paths.withColumn("__is_dir", F.lit(False)), spec.rules)
        paths = paths.join(ignored, "relpath", "left_anti")
    if spec.tracked is not None or spec.rules is not None:
        kept = kept.join(paths, "relpath", "left_semi")
    if spec.text_only:
        kept = kept.where(sniff.is_text(P.extension_key(_path()), bytes_of(df)))
    return kept


def selection_reasons(df: DataFrame, spec: Selection) -> DataFrame:
    """``(relpath, size_bytes, reason)``: the first test a file fails, or ``selected``.

    Content is reduced to one flag before anything is joined.
    """
    require(df, "relpath", "size_bytes")
    textual = sniff.is_text(P.extension_key(_path()), bytes_of(df))
    flags = df.select(
        "relpath", "size_bytes", (textual if spec.text_only else F.lit(True)).alias("__textual")
    )
    untracked = F.lit(False)
    if spec.tracked is not None:
        tracked = _tracked_paths(spec.tracked)
        if not tracked.isEmpty():
            hits = tracked.distinct().withColumn("__hit", F.lit(True))
            flags = flags.join(hits, "relpath", "left")
            untracked = F.col("__hit").isNull()
    ignored = F.lit(False)
    if spec.rules is not None:
        flags = with_ignored(flags, spec.rules, is_dir=F.lit(False))
        ignored = F.col("is_ignored")
    dotted = F.lit(False) if spec.include_dotfiles else ~not_dotted()
    reason = (
        F.when(dotted, "dotfile")
        .when(untracked, "untracked")
        .when(ignored, "ignored")
        .when(matches_glob(spec.exclude), "excluded")
        .when(~has_extension(spec.extensions), "extension")
        .when(~F.col("__textual"), "binary")
        .when(~within_size(spec.max_file_size), "too_large")
        .otherwise("selected")
    )
    return flags.select("relpath", "size_bytes", reason.alias("reason"))


def selection_audit(df: DataFrame, spec: Selection) -> DataFrame:
    """Files and bytes per reason."""
    return (
        selection_reasons(df, spec)
        .groupBy("reason")
        .agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("size_bytes"))
    )


def dry_run_manifest(df: DataFrame, spec: Selection) -> DataFrame:
    """Paths that ``select_files`` would keep; content is read only for the text test."""
    return select_files(df, spec).select("relpath")
