"""Shared folder, stored intermediates and column helpers for this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

CHECKPOINT_DIR = "spark.checkpoint.dir"
_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where it is unset a folder is made only if driver and executors are one process;
    on any other master a machine-local folder would lose data, so that is an error.
    """
    configured = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that the driver and all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="leafledger-llm-"))
    return _own[0]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(columns: Iterable[str], base: str) -> str:
    """``base``, lengthened until no column has it (names are compared without case)."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base += "_"
    return base


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def placed(df: DataFrame, columns: list[str], names: tuple[str, str]) -> DataFrame:
    """``columns`` of ``df`` with the file and the place in it that each row was read from.

    Rows that come from no file have their partition and their place in it.
    """
    kept = [col(c) for c in columns]
    try:
        return df.select(*kept, F.col("_metadata.file_path").alias(names[0]), F.col("_metadata.row_index").alias(names[1]))
    except AnalysisException:
        at = F.monotonically_increasing_id()
        part = F.format_string("part-%010d", F.shiftright(at, 33))
        return df.select(*kept, part.alias(names[0]), at.bitwiseAND(F.lit((1 << 33) - 1)).alias(names[1]))


def in_order_of_files(df: DataFrame, names: tuple[str, str], position: str) -> DataFrame:
    """``df`` with ``placed`` columns replaced by ``position`` from 0, and in that order.

    Spark numbers the files of a write by partition; the number decides, then the path. The
    table of files has a row per file, and so does its broadcast. Where rows of a file
    were left out, positions have gaps. ``df`` is read twice.
    """
    file, row = names
    number = F.regexp_extract(file, r"part-(\d+)[^/]*$", 1)
    files = df.groupBy(file).agg(F.max(F.col(row) + 1).alias("__n"))
    before = W.Window.orderBy(F.when(number != "", number.cast("long")).asc_nulls_last(), file).rowsBetween(W.Window.unboundedPreceding, -1)
    files = files.select(F.col(file).alias("__from"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    found = df.join(F.broadcast(files), F.col(file) == F.col("__from"))
    found = found.withColumn(position, (F.col("__start") + F.col(row)).cast("long"))
    return found.drop("__from", "__start", *names).orderBy(position)
