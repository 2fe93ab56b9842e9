"""Files larger than a row: blocks of whole lines, numbered and classified across tasks.

A block is a row ``relpath, block_no, text``; a file is its blocks in order, each of which ends
at a line end.  Of a block only its line codes (a letter per line) and two facts about it are
ordered: how many lines it has, and whether it leaves a block comment open, closes one or does
neither.  Both are scanned over ranges of blocks, so a file may span any number of tasks.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafledger.functions import linecodes
from leafledger.functions import paths as P
from leafledger.functions import text as TX
from leafledger.operators.lines import metric_columns
from leafledger.operators.running import carried, running_total
from leafledger.schema import require, text_of
from leafledger.session import shared_dir

ORDER, FILE = ["block_no"], ["relpath"]


def line_blocks(corpus: DataFrame, lines_per_block: int) -> DataFrame:
    """Files cut into blocks of so many lines, numbered from 0; an empty file has none."""
    lines = TX.split_lines(text_of(require(corpus, "relpath")))
    size = F.lit(lines_per_block)
    cuts = F.when(F.size("__lines") > 0, F.sequence(F.lit(0), F.floor((F.size("__lines") - 1) / size).cast("int")))
    cut = corpus.select("relpath", lines.alias("__lines")).select("relpath", "__lines", F.explode(cuts).alias("block_no"))
    part = F.slice("__lines", F.col("block_no") * size + 1, size)
    return cut.select("relpath", F.col("block_no").cast("long").alias("block_no"), F.concat(F.array_join(part, "\n"), F.lit("\n")).alias("text"))


def with_first_line(blocks: DataFrame) -> DataFrame:
    """Add ``first_line``, the number from 1 of the first line of each block in its file."""
    require(blocks, "relpath", "block_no")
    counted = blocks if "lines" in blocks.columns else blocks.withColumn("lines", TX.line_count(text_of(blocks)))
    ends = running_total(counted, F.col("lines"), ORDER, within=FILE, name="__end")
    return ends.withColumn("first_line", F.col("__end") - F.col("lines") + 1).drop("__end")


def _stored(coded: DataFrame) -> DataFrame:
    path = f"{shared_dir(coded.sparkSession)}/codes-{uuid.uuid4().hex}"
    coded.write.parquet(path)
    return coded.sparkSession.read.schema(coded.schema).parquet(path)


def block_codes(blocks: DataFrame) -> DataFrame:
    """``relpath, ext_key, block_no, codes``: a letter per line, what earlier blocks leave open included.

    Only letters are shuffled, never text. They are stored in the shared folder, as ranges and sums
    read them several times and texts should be split once.
    """
    text = text_of(require(blocks, "relpath", "block_no"))
    ext_key = P.extension_key(F.col("relpath"))
    coded = blocks.select("relpath", ext_key.alias("ext_key"), "block_no", linecodes.own_codes(ext_key, text).alias("codes"))
    seen = carried(_stored(coded), linecodes.transition(F.col("codes")), ORDER, within=FILE, name="__open")
    inside = F.coalesce(F.col("__open"), F.lit(False))
    return seen.withColumn("codes", linecodes.codes_after(F.col("codes"), inside)).drop("__open")


def classify_blocks(blocks: DataFrame) -> DataFrame:
    """A row per line, ``relpath, ext_key, line_no, kind``, as ``classify_lines`` has for whole files."""
    coded = block_codes(blocks).withColumn("lines", F.length("codes").cast("long"))
    placed = with_first_line(coded.where("lines > 0"))
    return placed.select("relpath", "ext_key", "first_line", F.posexplode(linecodes.kinds(F.col("codes"))).alias("at", "kind")).select(
        "relpath", "ext_key", (F.col("first_line") + F.col("at")).alias("line_no"), "kind"
    )


def block_metrics(blocks: DataFrame) -> DataFrame:
    """``file_metrics`` of files given as blocks; sums are taken per task before they are shuffled."""
    coded = block_codes(blocks.where(P.extension_key(F.col("relpath")).isNotNull()))
    counted = coded.select("relpath", "ext_key", *[c.alias(n) for n, c in metric_columns(F.col("codes")).items()])
    names = list(metric_columns(F.col("codes")))
    return counted.groupBy("relpath", "ext_key").agg(*[F.sum(n).alias(n) for n in names])
