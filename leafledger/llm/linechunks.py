"""Content-defined chunks of lines; chunks seen before anywhere are removed.

All chunks have two lines or more, unless the text has only one: where two neighbouring lines could
both end a chunk the first does, and no chunk ends just before the last line. Both rules look at
neighbouring lines only, so that chunks of a passage are the same whatever stands around it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafledger.llm.shared import col, free_name

#: Lines that a rolling hash covers, and one of how many hashes ends a chunk.
WINDOW = 2
DIVISOR = 3
#: A chunk of one line, which only a text of one line has, is never removed.
LEAST_LINES = 2


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def _number(*hashes: Column) -> Column:
    """28 bits of the digest of neighbouring line hashes."""
    digest = F.md5(F.concat(*hashes).cast("binary"))
    return F.conv(F.substring(digest, 1, 7), 16, 10).cast("long")


def _of_lines(lines: Column, window: int, divisor: int) -> Column:
    """Array of (start, size) of the chunks of an array of lines."""
    hashes = F.transform(lines, lambda line: F.md5(line.cast("binary")))

    def marks(h: Column) -> Column:
        rolled = lambda i: _number(*[F.get(h, i - j) for j in reversed(range(window))]) % divisor == 0
        return F.transform(F.sequence(F.lit(0), F.size(h) - 1), lambda i: F.when(i >= max(window - 1, 1), rolled(i)).otherwise(False))

    def ends(m: Column) -> Column:
        last = F.size(m) - 1
        return F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | (F.get(m, i) & (i < last - 1) & ~F.coalesce(F.get(m, i - 1), F.lit(False))))

    def bounds(e: Column) -> Column:
        start = lambda j: F.when(j == 0, F.lit(0)).otherwise(F.get(e, j - 1) + 1)
        return F.transform(e, lambda end, j: F.struct(start(j).alias("start"), (end + 1 - start(j)).alias("size")))

    return _once(_once(_once(hashes, marks), ends), bounds)


def _once(value: Column, used) -> Column:
    """``used`` of a value that is computed once, however often it stands there."""
    return F.transform(F.array(value), used)[0]


def chunks(text: Column, window: int = WINDOW, divisor: int = DIVISOR) -> Column:
    """Array of (start, size) in lines, from 0. A chunk ends where the hash of the last
    ``window`` line hashes is a multiple of ``divisor``: what stands before does not matter."""
    return _of_lines(_lines(text), window, divisor)


def _text_of(lines: Column, chunk: Column) -> Column:
    return F.array_join(F.slice(lines, chunk["start"] + 1, chunk["size"]), "\n")


def _occurrences(docs: DataFrame, id_column: str, text_column: str, cut: dict) -> DataFrame:
    """A row per chunk that may be removed: document, start, size, text and its digest."""
    text = col(text_column)
    rows = docs.select(col(id_column).alias("id"), F.xxhash64(text.cast("string")).alias("hash"), _lines(text).alias("lines"), chunks(text, **cut).alias("chunks"))
    rows = rows.select("id", "hash", "lines", F.explode(F.filter("chunks", lambda c: c["size"] >= LEAST_LINES)).alias("chunk"))
    rows = rows.select("id", "hash", F.col("chunk.start").alias("start"), F.col("chunk.size").alias("size"), _text_of(F.col("lines"), F.col("chunk")).alias("chunk"))
    return rows.withColumn("digest", F.md5(F.col("chunk").cast("binary")))


def repeated_chunks(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **cut) -> DataFrame:
    """``id``, ``hash``, ``removed``: the chunks (start, size) that a document loses.

    Grouping by the chunk's whole text compares bytes; each task first merges its own copies,
    so a chunk in every document arrives once per task. The first copy, by document id (null
    first), text and place, stays. A digest that two different texts share removes nothing.
    Digests then find the other copies in narrow rows; adaptive execution splits a hot one.
    """
    found = _occurrences(docs, id_column, text_column, cut)
    place = F.struct("id", "hash", "start")
    by_text = found.groupBy("digest", "chunk").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    by_digest = by_text.groupBy("digest").agg(F.count("*").alias("texts"), F.max("n").alias("n"), F.min("first").alias("first"))
    again = by_digest.where("texts = 1 and n > 1").select("digest", "first")
    lost = found.select("id", "hash", "start", "size", "digest").join(again, "digest")
    lost = lost.where(~place.eqNullSafe(F.col("first")))
    return lost.groupBy("id", "hash").agg(F.collect_set(F.struct("start", "size")).alias("removed"))


def without_repeated_chunks(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", names: tuple[str, str] = ("n_chunks", "n_removed"), **cut
) -> DataFrame:
    """``docs`` without chunks of lines that an earlier document, or an earlier place, has too.

    Adds how many chunks a row has and how many it lost. Rows that repeat an id with its text
    are one document. A null text stays null; a text may become empty but its row stays.
    An empty table stays empty; other columns are kept as they are.
    """
    lost = repeated_chunks(docs, id_column, text_column, **cut)
    id_, hash_, removed, whole = (free_name(docs.columns, n) for n in ("__id", "__hash", "__removed", "__whole"))
    lost = lost.select(F.col("id").alias(id_), F.col("hash").alias(hash_), F.col("removed").alias(removed))
    text = col(text_column)
    same = col(id_column).eqNullSafe(F.col(id_)) & (F.xxhash64(text.cast("string")) == F.col(hash_))
    rows = docs.join(lost, same, "left")
    parts = _once(_lines(text), lambda lines: F.struct(lines.alias("lines"), _of_lines(lines, cut.get("window", WINDOW), cut.get("divisor", DIVISOR)).alias("chunks")))
    rows = rows.withColumn(whole, parts)

    def rebuilt(x: Column) -> Column:
        return F.array_join(F.transform(F.array_except(x["chunks"], F.col(removed)), lambda c: _text_of(x["lines"], c)), "\n")

    n_chunks, n_removed = (free_name(docs.columns, n) for n in names)
    rows = rows.withColumn(n_chunks, F.size(F.col(whole)["chunks"]).cast("long"))
    rows = rows.withColumn(n_removed, F.coalesce(F.size(removed), F.lit(0)).cast("long"))
    rows = rows.withColumn(text_column, F.when(F.col(removed).isNull(), text.cast("string")).otherwise(_once(F.col(whole), rebuilt)))
    return rows.drop(id_, hash_, removed, whole)
