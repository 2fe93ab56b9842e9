"""Files as text, Markdown, HTML or JSON records: one string per file, built in its row."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafledger.functions import paths as P
from leafledger.functions import text as TX
from leafledger.functions.globs import comma_list
from leafledger.functions.lookups import fence_of
from leafledger.functions.tokens import rough_tokens
from leafledger.operators.budget import with_budget
from leafledger.operators.lines import numbered
from leafledger.operators.select import Selection, selection_reasons
from leafledger.schema import require, text_of

# The layouts.
RULE = "-" * 80
HTML_OPEN = '        <div class="file">\n            <div class="file-header">'
HTML_BODY = '</div>\n            <div class="file-content">\n'
HTML_CLOSE = "            </div>\n        </div>\n"
SPAN, SPAN_NUMBER, SPAN_END = '<span class="line">', '<span class="line-number">', "</span>"


def _body(lines: Column, render_line) -> Column:
    """Every line rendered and ended with a newline."""
    rendered = F.transform(lines, lambda line, at: F.concat(render_line(at + 1, line), F.lit("\n")))
    return F.array_join(rendered, "")


def text_header(path: Column) -> Column:
    return F.concat(F.lit("\n"), path, F.lit(f":\n{RULE}\n"))


def text_lines(lines: Column, is_numbered: bool) -> Column:
    return _body(lines, lambda n, line: numbered(n, line, "text" if is_numbered else None))


def text_block(path: Column, lines: Column, is_numbered: bool = True) -> Column:
    return F.concat(text_header(path), text_lines(lines, is_numbered))


def markdown_block(path: Column, lines: Column, is_numbered: bool = True) -> Column:
    style = "markdown" if is_numbered else None
    return F.concat(
        F.lit("\n### "), path, F.lit("\n```"), fence_of(P.extension(path)), F.lit("\n"),
        _body(lines, lambda n, line: numbered(n, line, style)), F.lit("```\n"),
    )


def html_block(path: Column, lines: Column, is_numbered: bool = True) -> Column:
    def span(n: Column, line: Column) -> Column:
        number = [F.lit(SPAN_NUMBER), n.cast("string"), F.lit(SPAN_END)] if is_numbered else []
        return F.concat(F.lit(SPAN), *number, TX.escape_html(line), F.lit(SPAN_END))

    return F.concat(
        F.lit(HTML_OPEN), TX.escape_html(path), F.lit(HTML_BODY), _body(lines, span), F.lit(HTML_CLOSE)
    )


BLOCKS = {"text": text_block, "markdown": markdown_block, "html": html_block}


def _render(corpus: DataFrame, block, is_numbered: bool) -> DataFrame:
    lines = TX.split_lines(text_of(require(corpus, "relpath")))
    return corpus.select("relpath", block(F.col("relpath"), lines, is_numbered).alias("block"))


def render_text(corpus: DataFrame, is_numbered: bool = True) -> DataFrame:
    return _render(corpus, text_block, is_numbered)


def render_markdown(corpus: DataFrame, is_numbered: bool = True) -> DataFrame:
    return _render(corpus, markdown_block, is_numbered)


def render_html(corpus: DataFrame, is_numbered: bool = True) -> DataFrame:
    return _render(corpus, html_block, is_numbered)


def _record(files: DataFrame, root: str, content: Column, skip_reason: Column, truncated: Column) -> DataFrame:
    path, text = F.col("relpath"), text_of(files)
    prefix = f"{root.rstrip('/')}/" if root else ""
    return files.select(
        F.concat(F.lit(prefix), path).alias("path"),
        path.alias("relative_path"),
        F.lit("text").alias("type"),
        F.col("size_bytes"),
        TX.line_count(text).alias("line_count"),
        F.substring_index(P.extension(path), ".", -1).alias("extension"),
        F.make_valid_utf8(content).alias("content"),
        (skip_reason != "").alias("skipped"),
        skip_reason.alias("skip_reason"),
        truncated.alias("truncated"),
    )


def export_files(
    corpus: DataFrame,
    root: str = "",
    spec: Selection | None = None,
    limit: int = 0,
    max_file: str | int | None = None,
) -> DataFrame:
    """The JSON record of each file; ``root`` is put before ``path``.

    A file that ``spec`` does not select, or that is above ``max_file``, is skipped: it keeps
    its record with the reason and without content.  A file that loses lines to ``limit`` is
    truncated and has the lines that fit.
    """
    require(corpus, "relpath", "size_bytes")
    chosen = corpus
    if spec is not None:
        reasons = selection_reasons(corpus, spec).where("reason <> 'selected'").select("relpath", "reason")
        chosen = corpus.join(reasons, "relpath", "left_anti")
    cut = with_budget(chosen, limit, True, max_file)
    text, too_large = text_of(chosen), F.col("too_large")
    lost = ~too_large & (F.col("kept_lines") < F.col("line_count"))
    lines = F.slice(TX.split_lines(text), F.lit(1), F.col("kept_lines").cast("int"))
    fitting = F.array_join(F.transform(lines, lambda line: F.concat(line, F.lit("\n"))), "")
    content = F.when(too_large, "").when(lost, fitting).otherwise(text)
    records = _record(cut, root, content, F.when(too_large, "too_large").otherwise(""), lost)
    if spec is None:
        return records
    skipped = corpus.join(reasons, "relpath")
    return records.unionByName(_record(skipped, root, F.lit(""), F.col("reason"), F.lit(False)))


def export_metadata(
    stats: DataFrame,
    directories: DataFrame,
    corpus: DataFrame,
    *,
    target: str = "",
    scan_time: str = "",
    output_format: str = "json",
    is_numbered: bool = True,
    extensions: str | Iterable[str] | None = None,
    exclude: str | Iterable[str] | None = None,
    max_file_size: str = "",
    character_limit: int = 0,
    include_dotfiles: bool = False,
    truncated: bool | Column = False,
    extra: DataFrame | None = None,
) -> DataFrame:
    """One row: options, counts, sizes, tokens; ``extra`` is a caller's one-row metadata.

    ``stats`` is ``basic_stats`` and ``directories`` is ``directory_count``.
    """
    one = lambda df, name: df.select(name).scalar()
    rough = corpus.agg(F.coalesce(F.sum(rough_tokens(F.col("size_bytes"))), F.lit(0)))
    strings = lambda xs: F.array(*map(F.lit, comma_list(xs))).cast("array<string>")
    row = stats.select(
        F.lit(target).alias("target_directory"),
        F.lit(scan_time).alias("scan_time"),
        "total_files",
        one(directories, "total_directories").alias("total_directories"),
        F.col("total_size").alias("total_size_bytes"),
        rough.scalar().alias("estimated_tokens"),
        "text_files",
        "binary_files",
        F.struct(
            F.lit(is_numbered).alias("include_line_numbers"),
            strings(extensions).alias("extensions_filter"),
            strings(exclude).alias("exclude_patterns"),
            F.lit(output_format).alias("format"),
            F.lit(max_file_size).alias("max_file_size"),
            F.lit(character_limit).cast("long").alias("character_limit"),
            F.lit(include_dotfiles).alias("include_dotfiles"),
        ).alias("options"),
        F.lit(truncated).alias("truncated"),
    )
    if extra is not None:
        fields = F.struct(*[F.col(c) for c in extra.columns])
        row = row.withColumn("git_info", extra.select(fields).scalar())
    return row
