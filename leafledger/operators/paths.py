"""Path columns and the directory entries implied by file paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafledger.functions import paths as P
from leafledger.schema import require


def with_path_columns(df: DataFrame) -> DataFrame:
    """Add ``base, dir, ext, ext_key, depth, top``."""
    path = F.col("relpath")
    return require(df, "relpath").withColumns(
        {
            "base": P.base_name(path),
            "dir": P.dir_name(path),
            "ext": P.extension(path),
            "ext_key": P.extension_key(path),
            "depth": P.depth(path),
            "top": P.top_component(path),
        }
    )


def entry_columns(df: DataFrame) -> DataFrame:
    """``(relpath, is_dir)`` completed to ``entries``."""
    path = F.col("relpath")
    return df.select(
        "relpath",
        P.dir_name(path).alias("parent"),
        P.base_name(path).alias("name"),
        P.depth(path).alias("depth"),
        "is_dir",
    )


def derive_entries(corpus: DataFrame) -> DataFrame:
    """Files plus every directory on the way to one, each once.

    The directories are made distinct before they are exploded into their
    ancestors, so a folder holding a third of all files is one row from the
    map side on.
    """
    paths = require(corpus, "relpath").select("relpath")
    folders = paths.select(P.dir_name(F.col("relpath")).alias("dir")).where("dir <> ''").distinct()
    parts = F.split("dir", "/")
    ancestors = folders.select(
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.size(parts)),
                lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
            )
        ).alias("relpath")
    ).distinct()
    files = paths.withColumn("is_dir", F.lit(False))
    return entry_columns(files.unionByName(ancestors.withColumn("is_dir", F.lit(True))))
