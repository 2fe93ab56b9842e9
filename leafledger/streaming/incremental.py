"""A profile kept up to date: files added, changed and removed in batches, content read once.

A batch becomes narrow facts, one row per file, and partial sums per class.  A file that an earlier
batch had is taken back from the sums by its old facts, so the sums of all partials are those
of the files as they are now.  Everything a batch writes lies under its number: a batch that is
run again replaces what it wrote.  ``compact`` merges batches; reports are the same before and after.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafledger.operators import profile as S
from leafledger.schema import require
from leafledger.streaming.late import read_batches

FACTS, SUMS = "facts", "sums"
#: Classes that sums are kept for.
KEYS = [*S.CLASSES, "age_bucket"]
_FACTS = (
    "relpath string, files long, size_bytes long, mtime {mtime}, ext string, ext_key string, is_text boolean, is_binary boolean, tokens long, "
    "size_bucket string, age_bucket string, measured long, lines long, code_lines long, blank_lines long, comments long, "
    "complexity_score double, complex_files long, batch long"
)


def _facts(spark: SparkSession, folder: str, mtime: str, before: int | None = None, paths: DataFrame | None = None) -> DataFrame:
    """The facts of each file, or of those at ``paths``, from the last batch that names it (or the last
    one ``before``); removed files are left out."""
    rows = read_batches(spark, f"{folder}/{FACTS}", _FACTS.format(mtime=mtime))
    if before is not None:
        rows = rows.where(F.col("batch") < before)
    if paths is not None:
        rows = rows.join(paths.select("relpath"), "relpath", "left_semi")
    values = [c for c in rows.columns if c not in ("relpath", "batch")]
    last = rows.groupBy("relpath").agg(F.max_by(F.struct(*values), F.col("batch")).alias("f"))
    return last.where("f.files > 0").select("relpath", *[F.col(f"f.{c}").alias(c) for c in values])


def _signed(facts: DataFrame, sign: int) -> DataFrame:
    return facts.select(*KEYS, *[(F.col(m) * sign).alias(m) for m in S.MEASURES])


def take_in(changed: DataFrame, folder: str, number: int, as_of: dt.datetime, removed: Column | None = None) -> None:
    """Adds batch ``number`` of files, new or changed, with ``mtime``; rows that are ``removed`` name files that are gone.

    A batch names a file once.  Numbers rise; a batch meets the narrow facts of those before it by path, and
    only of files that it names anything is shuffled on.
    """
    spark = changed.sparkSession
    require(changed, "relpath", "size_bytes", "mtime")
    mtime = changed.schema["mtime"].dataType.simpleString()
    gone = F.lit(False) if removed is None else F.coalesce(removed, F.lit(False))
    here = S.facts(changed.where(~gone), as_of)
    names = [c for c in here.columns if c != "relpath"]
    none = [F.lit(0 if c == "files" else None).cast(here.schema[c].dataType).alias(c) for c in names]
    rows = here.select("relpath", *names).union(changed.where(gone).select("relpath", *none))
    rows.write.mode("overwrite").parquet(f"{folder}/{FACTS}/batch={number}")
    written = spark.read.schema(rows.schema).parquet(f"{folder}/{FACTS}/batch={number}")
    replaced = _facts(spark, folder, mtime, number, written)
    parts = _signed(written.where("files > 0"), 1).unionByName(_signed(replaced, -1))
    sums = parts.groupBy(*KEYS).agg(*[F.sum(m).alias(m) for m in S.MEASURES])
    sums.write.mode("overwrite").parquet(f"{folder}/{SUMS}/batch={number}")


def _sums(spark: SparkSession, folder: str) -> DataFrame:
    text = ("ext", "size_bucket", "age_bucket")
    kinds = ", ".join(f"{k} {'string' if k in text else 'boolean'}" for k in KEYS)
    measures = ", ".join(f"{m} {'double' if m == 'complexity_score' else 'long'}" for m in S.MEASURES)
    return read_batches(spark, f"{folder}/{SUMS}", f"{kinds}, {measures}, batch long")


def condensed(spark: SparkSession, folder: str, mtime: str = "timestamp_ntz", with_times: bool = True) -> DataFrame:
    """What ``condense`` gives for the files as they are now, from the sums of all batches.

    Sums can be taken back, extremes cannot: ``oldest`` and ``newest`` come from the narrow facts,
    which are not read ``with_times=False``.
    """
    sums = _sums(spark, folder).groupBy(*KEYS).agg(*[F.sum(m).alias(m) for m in S.MEASURES]).where("files > 0")
    if with_times:
        times = _facts(spark, folder, mtime).groupBy(*KEYS).agg(F.min("mtime").alias("oldest"), F.max("mtime").alias("newest"))
        sums = sums.join(times, KEYS, "left")
    return sums.withColumn("ext_key", F.when(F.col("ext") != "", F.lower(F.substring_index("ext", ".", -1))))


def compact(spark: SparkSession, folder: str, into: str, number: int, mtime: str = "timestamp_ntz") -> None:
    """All batches up to ``number`` as one batch of that number in the new folder ``into``.

    Batches go on there; the old folder is left as it is, so that readers of it are not disturbed.
    """
    _facts(spark, folder, mtime).write.mode("overwrite").parquet(f"{into}/{FACTS}/batch={number}")
    condensed(spark, folder, with_times=False).select(*KEYS, *S.MEASURES).write.mode("overwrite").parquet(f"{into}/{SUMS}/batch={number}")
