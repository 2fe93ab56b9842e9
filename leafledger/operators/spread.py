"""Joining against a key that many rows share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spread_join(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    spread_by: Column,
    how: str = "left",
    salts: int | None = None,
) -> DataFrame:
    """Equi join in which one key of ``big`` is dealt out to ``salts`` tasks.

    ``small`` holds each key at most once per match and is repeated once per
    salt; ``spread_by`` is any column of ``big`` that varies within a key.  There are as many
    salts as it takes for a key with a third of all rows to be no larger than three shuffle
    partitions.
    Spark still turns this into a broadcast join when the measured size of
    ``small`` allows it.
    """
    partitions = int(big.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    salts = salts or max(2, -(-partitions // 9))
    salt = "__salt"
    dealt = big.withColumn(salt, F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    repeated = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(repeated, [*on, salt], how).drop(salt)
