"""Running totals and carried values over a global or per-group order, without one task per order."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

SAMPLES_PER_BUCKET = 16

_BUCKET, _OFFSET, _PART, _BOUNDS, _CUT = "__bucket", "__offset", "__part", "__bounds", "__cut"


def _bucket_count(df: DataFrame) -> int:
    """One range per shuffle partition: the cluster's setting decides how far work spreads."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def _key(columns: Sequence[str]) -> Column:
    return F.struct(*[F.col(c).alias(c) for c in columns])


def key_bounds(df: DataFrame, columns: Sequence[str], wanted: int) -> Column:
    """Quantile keys as a subquery: an array of at most ``wanted - 1`` bounds in order.

    They come from the ``wanted * SAMPLES_PER_BUCKET`` rows with the smallest key hashes, a sample
    that each task reduces before it is merged and that is the same on every run. It only steers the
    balance of the ranges: any bounds give right results. Nothing runs while the plan is built.
    """
    keys = df.select(*columns)
    sample = keys.orderBy(F.xxhash64(*columns), *columns).limit(wanted * SAMPLES_PER_BUCKET)
    ordered = sample.agg(F.sort_array(F.collect_list(_key(columns))).alias("keys"))
    places = F.sequence(F.lit(1), F.lit(wanted - 1))
    size = F.size("keys")
    picks = F.transform(places, lambda i: F.get("keys", F.floor(size * i / wanted).cast("int")))
    return ordered.select(F.when(size == 0, F.slice("keys", 1, 0)).otherwise(F.array_distinct(picks)).alias("bounds")).scalar()


def _range_of(columns: Sequence[str], bounds: Column) -> Column:
    """How many bounds are at or below the row's key: a binary search over the sorted array ``bounds``."""
    key = _key(columns)
    steps = F.sequence(F.lit(0), F.length(F.bin(F.size(bounds))))

    def halve(at: Column, _: Column) -> Column:
        middle = F.shiftright(at["low"] + at["high"], 1)
        above = F.get(bounds, middle) <= key
        narrower = F.struct(
            F.when(above, middle + 1).otherwise(at["low"]).alias("low"),
            F.when(above, at["high"]).otherwise(middle).alias("high"),
        )
        return F.when(at["low"] < at["high"], narrower).otherwise(at)

    start = F.struct(F.lit(0).alias("low"), F.size(bounds).alias("high"))
    return F.aggregate(steps, start, halve, lambda at: at["low"])


def with_range(df: DataFrame, columns: Sequence[str], bounds: Column, name: str) -> DataFrame:
    """``df`` with the number of its key's range; ``bounds`` is a subquery, as ``key_bounds`` gives it."""
    return df.withColumn(_BOUNDS, bounds).withColumn(name, _range_of(columns, F.col(_BOUNDS))).drop(_BOUNDS)


def _in_cut_group(within: Sequence[str], bounds: Column) -> Column:
    """Whether a bound falls into the row's group; no other group spans ranges.

    If any does, the bound just below the row or the one just above it is in the group, as all keys
    of a group lie together. So two bounds are compared, however many there are.
    """
    beside = (F.get(bounds, F.col(_BUCKET) - 1), F.get(bounds, F.col(_BUCKET)))
    mine = [functools.reduce(Column.__and__, (b[c].eqNullSafe(F.col(c)) for c in within), b.isNotNull()) for b in beside]
    return mine[0] | mine[1]


def _over_ranges(
    df: DataFrame,
    part: str,
    order: Sequence[str],
    within: Sequence[str],
    name: str,
    buckets: int | None,
    inside: Callable[[WindowSpec], Column],
    summary: Column,
    earlier: Callable[[Column, WindowSpec], Column],
    joined: Callable[[Column, Column], Column],
) -> DataFrame:
    """A scan of ``part`` in ``order``: within each range of the key, then over the ranges before it.

    ``inside`` is the scan of a range, ``summary`` what a range tells the later ones, ``earlier``
    combines the summaries of the ranges before, and ``joined`` both. The combined key of ``within``
    and ``order`` is cut into ranges. A bound falls inside at most one group, so only as
    many groups as there are bounds span ranges and the table of earlier summaries has at most twice
    as many rows as there are ranges: it is safe to broadcast. A group with a third of all rows is
    spread over a third of the ranges.

    Without ``within`` the shuffled rows also serve for the summaries, so that ``df`` is evaluated
    once for both; it should be narrow.
    """
    columns = [*within, *order]
    wanted = buckets or _bucket_count(df)
    bounds = key_bounds(df, columns, wanted) if wanted > 1 else None
    rows = df.withColumn(_BUCKET, F.lit(0)) if bounds is None else with_range(df, columns, bounds, _BUCKET)
    if bounds is not None and not within:
        rows = rows.repartition(_BUCKET)
    scanned = rows.withColumn(name, inside(Window.partitionBy(*within, _BUCKET).orderBy(*order)))
    if bounds is None:
        return scanned.drop(_PART, _BUCKET)

    spanning = rows
    if within:
        # A generated column, as Spark would move a condition on keys below the aggregation that made the rows.
        cut = F.explode(F.array(_in_cut_group(within, F.col(_BOUNDS)))).alias(_CUT)
        spanning = rows.withColumn(_BOUNDS, bounds).select("*", cut).where(_CUT).drop(_BOUNDS, _CUT)
    # Ranges follow the order, so their last keys order them; asking for these
    # makes the summaries need the same columns as the rows.
    rest = [c for c in rows.columns if c not in (*order, part, _BUCKET)]
    last = F.max(_BUCKET) if within else F.max(F.struct(*order, *rest))
    totals = spanning.groupBy(*within, _BUCKET).agg(summary.alias("__sum"), last.alias("__last"))
    before = (
        Window.partitionBy(*(within or [F.lit(0)]))
        .orderBy("__last")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = totals.select(
        *[F.col(c).alias(f"__{c}") for c in within],
        F.col(_BUCKET).alias("__b"),
        earlier(F.col("__sum"), before).alias(_OFFSET),
    )
    match = F.col(_BUCKET) == F.col("__b")
    for c in within:
        match = match & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return (
        scanned.join(F.broadcast(offsets), match, "left")
        .withColumn(name, joined(F.col(name), F.col(_OFFSET)))
        .drop(_OFFSET, "__b", _BUCKET, _PART, *[f"__{c}" for c in within])
    )


def running_total(
    df: DataFrame,
    value: Column | str,
    order: Sequence[str],
    within: Sequence[str] = (),
    name: str = "running",
    buckets: int | None = None,
) -> DataFrame:
    """``df`` with the inclusive running sum of ``value`` in ``order``, per ``within`` group.

    ``within`` + ``order`` must identify a row.
    """
    part = value if isinstance(value, str) else _PART
    rows = df if isinstance(value, str) else df.withColumn(_PART, value.cast("long"))
    return _over_ranges(
        rows, part, list(order), list(within), name, buckets,
        inside=lambda w: F.sum(part).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        summary=F.sum(part),
        earlier=lambda sums, before: F.coalesce(F.sum(sums).over(before), F.lit(0)),
        joined=lambda own, offset: own + F.coalesce(offset, F.lit(0)),
    )


def carried(
    df: DataFrame,
    value: Column,
    order: Sequence[str],
    within: Sequence[str] = (),
    name: str = "carried",
    buckets: int | None = None,
) -> DataFrame:
    """``df`` with the last ``value`` that is not null of the rows before, per ``within`` group.

    ``within`` + ``order`` must identify a row. A row's own value does not count.
    """
    last_place = F.when(F.col(_PART).isNotNull(), F.struct(*order))
    return _over_ranges(
        df.withColumn(_PART, value), _PART, list(order), list(within), name, buckets,
        inside=lambda w: F.last(_PART, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        summary=F.max_by(_PART, last_place),
        earlier=lambda values, before: F.last(values, ignorenulls=True).over(before),
        joined=lambda own, above: F.coalesce(own, above),
    )
