"""The packed corpus as one JSON document, written in parts that need only be put together.

The document is an object of ``metadata``, ``directory_tree`` (one string) and ``files`` (an array).
Its rows are pieces of it in order: what opens and closes them is a row of its own, or stands
before the first row of a section, so that every part is written by itself.  A line of the tree
ends in the escape for a newline, because it lies inside a string; other rows end in a newline.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafledger.functions import paths as P
from leafledger.operators import render
from leafledger.operators.paths import derive_entries
from leafledger.operators.running import running_total, with_range
from leafledger.operators.select import Selection, select_files
from leafledger.operators.tree import render_tree
from leafledger.plans.bundle import metadata_block
from leafledger.schema import require

HEAD, TREE, MIDDLE, FILES, TAIL = range(5)
#: Rows that are written together, and what ends each of them.
GROUPS = ((0, (HEAD,), "\n"), (1, (TREE,), "\\n"), (2, (MIDDLE, FILES, TAIL), "\n"))
MANIFEST, STAGED = "_manifest", "_blocks"
PART_BYTES = 128 << 20


def json_blocks(
    corpus: DataFrame,
    spec: Selection | None = None,
    limit: int = 0,
    max_file: str | int | None = None,
    entries: DataFrame | None = None,
    root: str = "",
) -> DataFrame:
    """``section, tree_key, relpath, block``: in the order of the first two the pieces of the document.

    Every file has a record; one that ``spec`` does not select or that is above ``max_file`` is skipped,
    with the reason, and one that loses lines to ``limit`` is truncated.  ``metadata`` counts the
    selected files and says whether any is truncated.
    """
    spec = spec or Selection()
    entries = derive_entries(corpus) if entries is None else entries
    records = render.export_files(corpus, root, spec, limit, max_file)
    truncated = records.agg(F.coalesce(F.bool_or("truncated"), F.lit(False))).scalar() if limit > 0 else F.lit(False)
    head = metadata_block(select_files(corpus, spec), entries, spec, True, limit, max_file, truncated)

    def row(section: int, block: Column, frame: DataFrame) -> DataFrame:
        return frame.select(F.lit(section).alias("section"), F.lit("").alias("tree_key"), F.lit("").alias("relpath"), block.alias("block"))

    one = corpus.sparkSession.range(1)
    drawn = render_tree(entries)
    first = drawn.agg(F.min("tree_key")).scalar()
    escaped = F.to_json(F.struct("line"))
    line = F.substr(escaped, F.lit(len('{"line":"') + 1), F.length(escaped) - len('{"line":""}'))
    tree = drawn.select(
        F.lit(TREE).alias("section"), "tree_key", "relpath",
        F.concat(F.when(F.col("tree_key") == first, '"directory_tree": "').otherwise(""), line).alias("block"),
    )
    opening = F.when(first.isNull(), '"directory_tree": "",').otherwise('",')
    key = P.tree_key(F.col("relative_path"))
    start = corpus.agg(F.min(P.tree_key(F.col("relpath")))).scalar()
    files = records.select(
        F.lit(FILES).alias("section"), key.alias("tree_key"), F.col("relative_path").alias("relpath"),
        F.concat(F.when(key == start, "").otherwise(","), F.to_json(F.struct(*records.columns))).alias("block"),
    )
    return (
        row(HEAD, F.concat(F.lit('{"metadata": '), F.col("block"), F.lit(",")), head)
        .unionByName(tree)
        .unionByName(row(MIDDLE, F.concat(opening, F.lit(' "files": [')), one))
        .unionByName(files)
        .unionByName(row(TAIL, F.lit("]}"), one))
    )


def _in_parts(rows: DataFrame, part_bytes: int, end: str) -> DataFrame:
    """``part`` and ``block`` of rows, rolled to the next part where one has ``part_bytes``.

    Sizes are summed over narrow rows; where parts begin is a list of keys, one a part, that rows
    look themselves up in.  So blocks are moved once, to the task of their part.
    """
    order = ["section", "tree_key"]
    sized = rows.select(*order, (F.octet_length("block") + len(end)).cast("long").alias("bytes"))
    ends = running_total(sized, "bytes", order, name="end")
    part = F.floor((F.col("end") - F.col("bytes")) / part_bytes)
    starts = ends.groupBy(part.alias("part")).agg(F.min(F.struct(*order)).alias("key")).where("part > 0")
    bounds = starts.agg(F.sort_array(F.collect_list("key"))).scalar()
    placed = with_range(rows, order, bounds, "part").withColumn("part", F.format_string("%010d", "part"))
    return placed.repartition("part").sortWithinPartitions("part", *order).select("part", "block")


def write_json_document(blocks: DataFrame, path: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """Writes the pieces as files of about ``part_bytes``; the manifest, which is returned, comes last.

    The manifest has ``name`` and ``bytes`` of each file: put together in the order of names they are
    the document.  Where it is missing, a write has not ended.  The pieces are first stored beside it,
    as sizes are summed before they are written: the corpus is thus read once.
    """
    require(blocks, "section", "tree_key", "block")
    kept = blocks.select("section", "tree_key", "block")
    kept.write.parquet(f"{path}/{STAGED}")
    stored = blocks.sparkSession.read.schema(kept.schema).parquet(f"{path}/{STAGED}")
    for group, sections, end in GROUPS:
        rows = stored.where(F.col("section").isin(*sections))
        _in_parts(rows, part_bytes, end).write.partitionBy("part").option("lineSep", end).text(f"{path}/group={group}")
    return _manifest(blocks.sparkSession, path)


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", "(group=[^/]*/.*)$", 1)
    named = found.where("length > 0").select(name.alias("name"), F.col("length").alias("bytes"))
    named.repartition(1).sortWithinPartitions("name").write.parquet(f"{path}/{MANIFEST}")
    return spark.read.parquet(f"{path}/{MANIFEST}")


def read_json_document(spark: SparkSession, path: str) -> DataFrame:
    """``section, line`` of a written document: its rows without what ends them, in no order.

    A name with a backslash before an ``n`` comes as two lines of the tree here, though not in the document.
    """
    read = []
    for group, sections, end in GROUPS:
        rows = spark.read.option("lineSep", end).option("recursiveFileLookup", "true").text(f"{path}/group={group}")
        section = F.lit(sections[0])
        if len(sections) > 1:
            section = F.when(F.startswith("value", F.lit("]")), TAIL).when(F.rlike("value", F.lit("^,?\\{")), FILES).otherwise(MIDDLE)
        read.append(rows.select(section.alias("section"), F.col("value").alias("line")))
    return read[0].union(read[1]).union(read[2])
