"""Sources interleaved by target weight: Pfair windows per block, earliest deadline first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from leafledger.llm.shared import col, stored

#: Characters of a block, the unit that is scheduled.
BLOCK_CHARS = 1 << 14
#: Rows that share a running total; what a source has beyond that is cut into more ranges.
RANGE_ROWS = 20_000
#: Slots of a period times sources; more would make the one-row schedule slow, so it is an error.
MAX_STEPS = 1 << 26

# One slot: of the sources whose next block is released, the one with the earliest deadline;
# equal deadlines go to the source that is first by name.
_PICK = """
array_min(transform(s.taken, (n, i) -> CASE
  WHEN n < ks[i] AND (n * period) div ks[i] <= t
  THEN named_struct('deadline', ((n + 1) * period + ks[i] - 1) div ks[i], 'i', i) END)).i
"""
_EDF = f"""
aggregate(sequence(0L, period - 1),
  named_struct('taken', transform(ks, k -> 0L), 'order', cast(array() AS array<int>)),
  (s, t) -> aggregate(array({_PICK}), s, (a, pick) -> named_struct(
    'taken', transform(a.taken, (n, i) -> n + if(i = pick, 1L, 0L)),
    'order', concat(a.order, array(pick)))),
  s -> s.order)
"""


def source_weights(sources: DataFrame, weights: dict[str, int], default_weight: int) -> DataFrame:
    """``source``, ``k``: whole-number weight of each distinct source; null is a source too."""
    if any(int(k) != k or k < 1 for k in [default_weight, *weights.values()]):
        raise ValueError("weights are whole numbers of at least 1")
    known = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else None
    own = known[F.col("source")] if weights else F.lit(None)
    return sources.select("source", F.coalesce(own, F.lit(default_weight)).cast("long").alias("k"))


def schedule(weighted: DataFrame) -> DataFrame:
    """``source``, ``k``, ``period``, ``nth``, ``slot``: one period of the interleaving.

    With weights ``k`` that add up to ``period``, block ``nth`` of a source (from 0) is released
    at floor(nth * period / k) and due by ceil((nth + 1) * period / k). Every slot is used and
    every block lies in its window, so each source is always less than one block from its due.
    """
    row = weighted.agg(F.sort_array(F.collect_list(F.struct("source", "k"))).alias("all"), F.sum("k").alias("period"))
    size = row.select(F.size("all").alias("n"), "period").head()
    if size.period is not None and size.n * size.period > MAX_STEPS:
        raise ValueError(f"{size.n} sources over a period of {size.period} slots; use smaller weights")
    row = row.where("period is not null").selectExpr("all", "period", "all.k AS ks")
    slots = row.selectExpr("all", "period", f"posexplode({_EDF}) AS (slot, i)")
    slots = slots.selectExpr("all[i].source AS source", "all[i].k AS k", "period", "cast(slot AS long) AS slot")
    nth = F.row_number().over(W.Window.partitionBy("source").orderBy("slot")) - 1
    return slots.withColumn("nth", nth.cast("long"))


def _keyed(docs: DataFrame, id_column: str, text_column: str, ranges: int) -> DataFrame:
    """Adds the size in characters, a key that shuffles documents, and its range."""
    identity = F.concat(F.coalesce(col(id_column).cast("string"), F.lit("null")), F.lit(":"), F.coalesce(col(text_column).cast("string"), F.lit("")))
    key = F.md5(identity.cast("binary"))
    place = F.conv(F.substring("__key", 1, 7), 16, 10).cast("long")
    return (
        docs.withColumn("__size", F.coalesce(F.length(col(text_column).cast("string")), F.lit(0)).cast("long"))
        .withColumn("__key", key)
        .withColumn("__range", F.floor(place * F.lit(ranges) / F.lit(1 << 28)).cast("long"))
    )


def _starts(keyed: DataFrame, source_column: str) -> DataFrame:
    """Characters of a source before each of its ranges."""
    sums = keyed.groupBy(col(source_column).alias("source"), F.col("__range").alias("range")).agg(F.sum("__size").alias("size"))
    before = W.Window.partitionBy("source").orderBy("range").rowsBetween(W.Window.unboundedPreceding, -1)
    return sums.select("source", "range", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))


def _placed(keyed: DataFrame, starts: DataFrame, plan: DataFrame, source_column: str, block_chars: int) -> DataFrame:
    """Adds block, slot and window to keyed rows: running totals per range, never per source."""
    before = (
        W.Window.partitionBy(col(source_column), "__range").orderBy("__key").rowsBetween(W.Window.unboundedPreceding, -1)
    )
    rows = keyed.withColumn("__before", F.coalesce(F.sum("__size").over(before), F.lit(0)))
    rows = rows.join(starts, col(source_column).eqNullSafe(F.col("source")) & (F.col("__range") == F.col("range")))
    rows = rows.withColumn("__offset", F.col("start") + F.col("__before")).drop("source", "range", "start")
    rows = rows.withColumn("__block", F.expr(f"__offset div {int(block_chars)}"))
    weights = plan.select(F.col("source").alias("w_source"), "k", "period").distinct()
    rows = rows.join(F.broadcast(weights), col(source_column).eqNullSafe(F.col("w_source")))
    slots = plan.select(F.col("source").alias("s_source"), "nth", "slot")
    same = col(source_column).eqNullSafe(F.col("s_source")) & (F.expr("__block % k") == F.col("nth"))
    rows = rows.join(F.broadcast(slots), same)
    return (
        rows.withColumn("__slot", F.expr("(__block div k) * period + slot"))
        .withColumn("__release", F.expr("(__block * period) div k"))
        .withColumn("__deadline", F.expr("((__block + 1) * period + k - 1) div k"))
    )


def _ranges(docs: DataFrame) -> int:
    return max(1, -(-docs.count() // RANGE_ROWS))


def _plan(docs: DataFrame, source_column: str, weights: dict[str, int], default_weight: int) -> DataFrame:
    sources = docs.select(col(source_column).cast("string").alias("source")).distinct()
    return stored(schedule(source_weights(sources, weights, default_weight)), "schedule")


def mix(
    docs: DataFrame,
    weights: dict[str, int],
    default_weight: int = 1,
    block_chars: int = BLOCK_CHARS,
    id_column: str = "doc_id",
    source_column: str = "source",
    text_column: str = "text",
) -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``block``, ``release``, ``deadline``, ``slot``, ``place``.

    A source's documents, shuffled by a digest of id and text, fill blocks of ``block_chars``
    characters; a document belongs to the block in which it starts and is emitted whole at that
    block's slot. After any slot a source with documents left has thus emitted less than one
    block less, and less than one block plus its longest document more, than its weight's
    share of the slots so far, in characters. Slots interleave the blocks
    of all sources in the ratio of their weights; ``place`` orders the documents of a slot.
    Every row has one place: where a source ends, the slots it would have had stay empty and
    the others keep their ratio. A null source is a source, a null text has size 0, repeated
    rows follow each other. An empty table gives an empty result.

    The schedule has as many rows as its period, which ``MAX_STEPS`` bounds, and is broadcast.
    """
    plan = _plan(docs, source_column, weights, default_weight)
    narrow = docs.select(
        col(id_column).alias("doc_id"), col(source_column).cast("string").alias("doc_source"), col(text_column).cast("string").alias("text")
    )
    keyed = stored(_keyed(narrow, "doc_id", "text", _ranges(docs)).drop("text"), "mix")
    rows = _placed(keyed, _starts(keyed, "doc_source"), plan, "doc_source", block_chars)
    return rows.select(
        "doc_id", F.col("doc_source").alias("source"), F.col("__size").alias("size"), F.col("__block").alias("block"),
        F.col("__release").alias("release"), F.col("__deadline").alias("deadline"), F.col("__slot").alias("slot"),
        F.struct(F.col("__offset").alias("offset"), F.col("__key").alias("key")).alias("place"),
    )


def in_mixed_order(
    docs: DataFrame,
    weights: dict[str, int],
    default_weight: int = 1,
    block_chars: int = BLOCK_CHARS,
    id_column: str = "doc_id",
    source_column: str = "source",
    text_column: str = "text",
) -> DataFrame:
    """All rows of ``docs`` in the order of ``mix``: files written from it follow the mixture."""
    plan = _plan(docs, source_column, weights, default_weight)
    packed = docs.select(
        F.struct(*[col(c) for c in docs.columns]).alias("row"),
        col(id_column).alias("doc_id"), col(source_column).cast("string").alias("doc_source"), col(text_column).cast("string").alias("text"),
    )
    keyed = _keyed(packed, "doc_id", "text", _ranges(docs)).select("row", "doc_source", "__size", "__key", "__range")
    starts = stored(_starts(keyed, "doc_source"), "starts")
    rows = _placed(keyed, starts, plan, "doc_source", block_chars)
    return rows.orderBy("__slot", "__offset", "__key").select("row.*")
