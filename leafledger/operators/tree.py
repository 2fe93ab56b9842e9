"""Tree order and the drawn tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafledger.functions import paths as P
from leafledger.operators.running import running_total
from leafledger.operators.spread import spread_join
from leafledger.schema import require

# The drawing pieces.
BRANCH, LAST_BRANCH = "├── ", "└── "
RAIL, GAP = "│   ", "    "


def tree_order(entries: DataFrame) -> DataFrame:
    """Entries with ``tree_key`` and their 1-based ``position`` in the tree."""
    key = P.tree_key(F.col("relpath"), F.col("is_dir"))
    keyed = require(entries, "relpath", "is_dir").withColumn("tree_key", key)
    return running_total(keyed, F.lit(1), ["tree_key"], name="position")


def render_tree(entries: DataFrame) -> DataFrame:
    """A drawn ``line`` per entry, with ``tree_key`` to sort by.

    The last child of each directory is a maximum, found by partial
    aggregation, and is matched back on its own path.  Rails depend only on the
    directories above, so they are built once per directory and then looked up
    by parent; both lookups spread keys that many rows share.
    """
    require(entries, "relpath", "parent", "name", "is_dir")
    newest = F.max(F.struct((~F.col("is_dir")).alias("leaf"), F.col("name"), F.col("relpath")))
    last = (
        entries.groupBy("parent").agg(newest.alias("m"))
        .select(F.col("m.relpath").alias("relpath"), F.lit(True).alias("is_last"))
    )
    marked = entries.select("relpath", "parent", "name", "is_dir").join(last, "relpath", "left")
    marked = marked.withColumn("is_last", F.coalesce("is_last", F.lit(False)))

    folders = marked.where("is_dir").select("relpath", "is_last")
    parts = F.split("relpath", "/")
    above = folders.select(
        F.col("relpath").alias("folder"),
        F.posexplode(
            F.transform(
                F.sequence(F.lit(1), F.size(parts)),
                lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
            )
        ).alias("level", "relpath"),
    )
    pieces = spread_join(above, folders, ["relpath"], F.col("folder"), "inner").select(
        "folder", "level", F.when(F.col("is_last"), GAP).otherwise(RAIL).alias("piece")
    )
    rails = pieces.groupBy("folder").agg(
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct("level", "piece"))), lambda p: p["piece"]
            ),
            "",
        ).alias("rail")
    )
    drawn = spread_join(
        marked, rails.withColumnRenamed("folder", "parent"), ["parent"], F.col("relpath")
    )
    line = F.concat(
        F.coalesce("rail", F.lit("")),
        F.when(F.col("is_last"), LAST_BRANCH).otherwise(BRANCH),
        F.col("name"),
        F.when(F.col("is_dir"), "/").otherwise(""),
    )
    return drawn.select(
        "relpath",
        "is_dir",
        P.tree_key(F.col("relpath"), F.col("is_dir")).alias("tree_key"),
        line.alias("line"),
    )
