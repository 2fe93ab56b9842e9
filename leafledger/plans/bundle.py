"""The packed corpus: the drawn tree, then every selected file in tree order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafledger.functions import paths as P
from leafledger.functions import text as TX
from leafledger.functions.sizes import parse_size
from leafledger.operators import budget, render
from leafledger.operators import profile as S
from leafledger.operators.paths import derive_entries
from leafledger.operators.select import Selection, select_files
from leafledger.operators.tree import render_tree
from leafledger.schema import text_of
from leafledger.sources.sinks import output_format

# What stands before the tree, and between the tree and the files.
HEADINGS = {
    "text": ("", "\n"),
    "markdown": ("# Project Structure\n\n## Directory Tree\n```\n", "\n```\n\n## Files\n"),
    "html": ('<div class="tree">', "</div>\n"),
}
TREE, FILES = 1, 3


def _text_files(files: DataFrame, limit: int, is_numbered: bool, max_file) -> DataFrame:
    """Text blocks under both limits, notes in place of what is missing."""
    cut = budget.with_budget(files, limit, is_numbered, max_file)
    lines = F.slice(TX.split_lines(text_of(files)), F.lit(1), F.col("kept_lines").cast("int"))
    bound = parse_size(max_file)
    lost = F.col("kept_lines") < F.col("line_count")
    body = F.when(
        F.col("too_large"),
        F.concat(budget.too_large_message(F.col("size_bytes"), bound), F.lit("\n")),
    ).otherwise(
        F.concat(
            render.text_lines(lines, is_numbered),
            F.when(lost, budget.truncated_message(limit) + "\n").otherwise(""),
        )
    )
    block = F.concat(render.text_header(F.col("relpath")), body)
    return cut.select("tree_key", "relpath", block.alias("block"))


def bundle(
    corpus: DataFrame,
    spec: Selection | None = None,
    format: str = "text",
    limit: int = 0,
    max_file: str | int | None = None,
    is_numbered: bool = True,
    entries: DataFrame | None = None,
) -> DataFrame:
    """``section, tree_key, relpath, block``; sorted by the first two it is the document.

    The tree shows all entries, the files are the selected ones.  Both limits
    belong to the text format and to ``json``, whose blocks are JSON records: first the metadata,
    then the tree, then the files.  ``plans.document`` has them as one JSON document.  ``write_bundle`` sorts and writes; nothing is sorted here.
    """
    kind = output_format(format)
    spec = spec or Selection()
    entries = derive_entries(corpus) if entries is None else entries
    files = select_files(corpus, spec)
    drawn = render_tree(entries)

    line = F.concat("line", F.lit("\n"))
    if kind == "html":
        line = F.concat(TX.escape_html(F.col("line")), F.lit("<br>"))
    if kind == "json":
        line = F.to_json(F.struct("relpath", "is_dir", "line"))
    tree = drawn.select(F.lit(TREE).alias("section"), "tree_key", "relpath", line.alias("block"))

    key = P.tree_key(F.col("relpath"))
    if kind == "text":
        body = _text_files(files, limit, is_numbered, max_file)
    elif kind == "json":
        record = render.export_files(files, limit=limit, max_file=max_file)
        body = record.select(
            P.tree_key(F.col("relative_path")).alias("tree_key"),
            F.col("relative_path").alias("relpath"),
            F.to_json(F.struct(*record.columns)).alias("block"),
        )
    else:
        lines = TX.split_lines(text_of(files))
        block = render.BLOCKS[kind](F.col("relpath"), lines, is_numbered)
        body = files.select(key.alias("tree_key"), "relpath", block.alias("block"))
    out = tree.unionByName(body.withColumn("section", F.lit(FILES)))
    if kind in HEADINGS:
        before, between = HEADINGS[kind]
        rows = [(0, "", "", before)] if before else []
        rows.append((TREE + 1, "", "", between))
        heading = corpus.sparkSession.createDataFrame(
            rows, "section int, tree_key string, relpath string, block string"
        )
        out = out.unionByName(heading)
    if kind == "json":
        lost = record.agg(F.coalesce(F.bool_or("truncated"), F.lit(False))).scalar() if limit > 0 else F.lit(False)
        out = out.unionByName(metadata_block(files, entries, spec, is_numbered, limit, max_file, lost))
    return out


def metadata_block(
    files: DataFrame,
    entries: DataFrame,
    spec: Selection,
    is_numbered: bool,
    limit: int = 0,
    max_file: str | int | None = None,
    truncated: Column | bool = False,
) -> DataFrame:
    """The record that heads a JSON bundle, about the selected files."""
    stats = S.basic_stats(S.facts(files, with_lines=False))
    row = render.export_metadata(
        stats, S.directory_count(entries), files, is_numbered=is_numbered, extensions=spec.extensions,
        exclude=spec.exclude, max_file_size=str(max_file or spec.max_file_size or ""), character_limit=limit,
        include_dotfiles=spec.include_dotfiles, truncated=truncated,
    )
    block = F.to_json(F.struct(*[F.col(c) for c in row.columns]))
    return row.select(F.lit(0).alias("section"), F.lit("").alias("tree_key"), F.lit("").alias("relpath"), block.alias("block"))
