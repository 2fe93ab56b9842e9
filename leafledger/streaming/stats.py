"""Structured Streaming forms of the statistics that add up file by file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafledger.functions import paths as P
from leafledger.functions import sniff, tokens
from leafledger.schema import bytes_of, require, text_of


def _measured(files: DataFrame) -> DataFrame:
    path, text = F.col("relpath"), text_of(files)
    ext_key = P.extension_key(path)
    textual = sniff.is_text(ext_key, bytes_of(files))
    counted = tokens.file_tokens(ext_key, text)
    return files.withColumns(
        {
            "ext": P.extension(path),
            "is_text": textual,
            "tokens": F.when(textual, counted).otherwise(0),
        }
    )


def corpus_stats_stream(files: DataFrame) -> DataFrame:
    """Running files, bytes, text files and tokens per extension.

    For ``update`` or ``complete`` mode; the state is one row per extension.
    """
    require(files, "relpath", "size_bytes")
    return _measured(files).groupBy(F.col("ext").alias("extension")).agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("size_bytes").alias("size_bytes"),
        F.count_if("is_text").alias("text_files"),
        F.sum("tokens").alias("tokens"),
    )


def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def is_local(files: DataFrame) -> bool:
    return isinstance(files.schema["mtime"].dataType, T.TimestampNTZType)


def timed(files: DataFrame) -> DataFrame:
    """Files with their measures and ``at``, the instant of ``mtime``.

    Watermarks need instants; a time without zone is read as UTC, whatever the session's zone.
    """
    since = F.timestamp_diff("MICROSECOND", _epoch(), F.col("mtime"))
    return _measured(files).withColumn("at", F.timestamp_micros(since) if is_local(files) else F.col("mtime"))


def local(instant: Column) -> Column:
    """The time without zone that ``timed`` read as this instant."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), _epoch())


def growth_sums(grouped: GroupedData) -> DataFrame:
    return grouped.agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("size_bytes").alias("size_bytes"),
        F.sum("tokens").alias("tokens"),
    )


def corpus_growth(files: DataFrame, window: str = "1 day", delay: str | None = "1 day") -> DataFrame:
    """Files, bytes and tokens per tumbling window of ``mtime``.

    In ``append`` mode a window is written once the watermark has passed its
    end; files that arrive for a written window are dropped (``streaming.late`` keeps them).
    Without ``delay`` no window is ever closed: ``update`` and ``complete`` mode then give every
    window and count every file.
    """
    require(files, "relpath", "size_bytes", "mtime")
    restored = local if is_local(files) else (lambda c: c)
    rows = timed(files)
    if delay is not None:
        rows = rows.withWatermark("at", delay)
    return growth_sums(rows.groupBy(F.window("at", window).alias("w"))).select(
        restored(F.col("w.start")).alias("window_start"),
        restored(F.col("w.end")).alias("window_end"),
        "files", "size_bytes", "tokens",
    )


def drain(frame: DataFrame, folder: str, keys: list[str]) -> DataFrame:
    """Runs a streaming aggregation over all that has arrived; its result so far, by ``keys``.

    Each batch writes the rows that it has changed below ``folder``, under its number, so that a
    batch that is run again replaces its own rows.  The last row of each key counts.
    """

    def write(changed: DataFrame, number: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/table/batch={number}")

    stream = (
        frame.writeStream.foreachBatch(write).outputMode("update")
        .option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    )
    stream.awaitTermination()
    numbered = T.StructType([*frame.schema.fields, T.StructField("batch", T.LongType())])
    rows = frame.sparkSession.read.schema(numbered).parquet(f"{folder}/table")
    values = [c for c in frame.columns if c not in keys]
    last = F.max_by(F.struct(*values), F.col("batch")).alias("v")
    return rows.groupBy(*keys).agg(last).select(*[F.col(c) if c in keys else F.col(f"v.{c}") for c in frame.columns])
