"""Growth per window of a stream that also keeps what comes too late, as tables of partials.

A batch is judged by the watermark that the batches before it left: the latest time seen, less a
delay.  Rows of windows that had ended by then go to the table of late rows; all others are summed
per window, a partial per batch.  Everything a batch writes lies under its number, so a batch
that is run again replaces what it wrote, and lost executors cost a batch at most.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafledger.schema import require
from leafledger.streaming.stats import growth_sums, timed

MARKS, PARTIALS, LATE = "marks", "partials", "late"


def read_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of batches, or none of its rows before the first was written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def _mark(spark: SparkSession, folder: str, before: int | None = None) -> Column:
    """The latest time of all batches, or of those before one, as a subquery."""
    marks = read_batches(spark, f"{folder}/{MARKS}", "latest timestamp, batch long")
    return (marks if before is None else marks.where(F.col("batch") < before)).agg(F.max("latest")).scalar()


def drain_growth(files: DataFrame, folder: str, window: str = "1 day", delay: str = "1 day") -> None:
    """Takes in all that has arrived in a stream of ``relpath, size_bytes, mtime`` and a text.

    It may be called again with the same ``folder`` when more has arrived: progress, the
    watermark and all sums go on from where they were.
    """
    require(files, "relpath", "size_bytes", "mtime")
    allowance = F.expr(f"INTERVAL {delay}")

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        ended = F.col("w.end") + allowance <= _mark(spark, folder, number)
        rows = timed(batch).withColumn("w", F.window("at", window)).withColumn("is_late", F.coalesce(ended, F.lit(False)))
        late = rows.where("is_late").select("relpath", "size_bytes", "mtime")
        late.write.mode("overwrite").parquet(f"{folder}/{LATE}/batch={number}")
        sums = growth_sums(rows.where("NOT is_late").groupBy("w"))
        sums.select("w.start", "w.end", "files", "size_bytes", "tokens").write.mode("overwrite").parquet(f"{folder}/{PARTIALS}/batch={number}")
        latest = rows.agg(F.max("at").alias("latest"))
        latest.write.mode("overwrite").parquet(f"{folder}/{MARKS}/batch={number}")

    stream = files.writeStream.foreachBatch(take).option("checkpointLocation", f"{folder}/progress")
    stream.trigger(availableNow=True).start().awaitTermination()


_PARTIAL = "start timestamp, `end` timestamp, files long, size_bytes long, tokens long, batch long"


def windows(spark: SparkSession, folder: str, delay: str = "1 day") -> DataFrame:
    """``window_start, window_end, files, size_bytes, tokens, is_closed`` of all windows so far.

    A window is closed once the watermark has passed its end: what arrives for it now is late.
    """
    parts = read_batches(spark, f"{folder}/{PARTIALS}", _PARTIAL)
    ended = F.col("end") + F.expr(f"INTERVAL {delay}") <= _mark(spark, folder)
    sums = parts.groupBy("start", "end").agg(*[F.sum(n).alias(n) for n in ("files", "size_bytes", "tokens")])
    return sums.select(
        F.col("start").alias("window_start"), F.col("end").alias("window_end"), "files", "size_bytes", "tokens",
        F.coalesce(ended, F.lit(False)).alias("is_closed"),
    )


def late_rows(spark: SparkSession, folder: str, mtime: str = "timestamp_ntz") -> DataFrame:
    """``relpath, size_bytes, mtime, batch`` of all rows that came after their window was closed."""
    return read_batches(spark, f"{folder}/{LATE}", f"relpath string, size_bytes long, mtime {mtime}, batch long")
