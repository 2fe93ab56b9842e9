"""Lines of text files of any size, read by Spark's own splits and numbered across them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafledger.functions import paths as P
from leafledger.operators.lines import split_lines
from leafledger.operators.running import running_total
from leafledger.sources.files import list_entries, load_contents

_LEAVES_OUT = "(^|/)([.]|_(?![^/]*=))|[.]_COPYING_(/|$)"
_SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"
COLUMNS = ["relpath", "ext_key", "line_no", "line"]


def _below(root: str, address: Column) -> Column:
    """The path of a file below ``root`` from the address that the reader gives, which has escapes."""
    plain = F.url_decode(F.replace(address, F.lit("+"), F.lit("%2B")))
    where = F.rtrim(F.regexp_replace(F.lit(root), _SCHEME, ""), F.lit("/"))
    return F.substr(F.regexp_replace(plain, _SCHEME, ""), F.length(where) + 2)


def _visible_lines(spark: SparkSession, root: str) -> DataFrame:
    """Numbered lines of the files that Spark's listing shows."""
    reader = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true")
    rows = reader.text(root).select(
        F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"),
        F.monotonically_increasing_id().alias("__id"), F.regexp_replace("value", "\\r\\z", "").alias("line"),
    )
    # Within a block ids count its lines; which splits there are follows from sizes and settings.
    blocks = rows.groupBy("__file", "__start").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__lines"))
    ends = running_total(blocks, F.col("__lines"), ["__start"], within=["__file"], name="__end")
    # Paths are made once per split: per line they cost far more than reading it does. They are a generated
    # column, as Spark would copy conditions on paths that follow from the address to the lines.
    shift = (F.col("__end") - F.col("__lines") - F.col("__first") + 1).alias("__shift")
    ends = ends.select("__file", "__start", shift, F.explode(F.array(_below(root, F.col("__file")))).alias("relpath"))
    ends = ends.withColumn("ext_key", P.extension_key(F.col("relpath")))
    return rows.join(ends, ["__file", "__start"]).select(
        "relpath", "ext_key", (F.col("__id") + F.col("__shift")).alias("line_no"), "line"
    )


def read_lines(spark: SparkSession, root: str, include_dotfiles: bool = False) -> DataFrame:
    """``relpath, ext_key, line_no, line`` of all files below ``root``.

    A file is read by as many tasks as it has splits (``spark.sql.files.maxPartitionBytes``); a split's
    lines are counted first, and sums of these counts number the lines of all. Lines
    end at ``\\n``, one ``\\r`` before it is dropped and a final newline adds no line, as in
    ``split_lines``; a byte order mark at the start of a file is dropped by the reader. Names
    that Spark's listing leaves out (``_name``, and ``.name`` if asked for) are read whole, a file to a row.
    """
    shown = _visible_lines(spark, root)
    hidden = list_entries(spark, root, include_dotfiles).where(~F.col("is_dir") & F.rlike("relpath", F.lit(_LEAVES_OUT)))
    loaded = load_contents(hidden, root).where("content IS NOT NULL")
    rest = split_lines(loaded).withColumn("line_no", F.col("line_no").cast("long"))
    return shown.select(COLUMNS).unionByName(rest.select(COLUMNS))
