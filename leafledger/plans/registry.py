"""The registered queries: one per operator, over the whole given tables."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafledger.functions import tokens as T
from leafledger.operators import blocks, budget, health, ignore, lines, paths, render, select
from leafledger.operators import profile as S
from leafledger.operators import status as G
from leafledger.operators import tree
from leafledger.plans import bundle as B
from leafledger.plans import document
from leafledger.plans import profile as E
from leafledger.sources import tables as D
from leafledger.sources import textlines
from leafledger.sources.files import list_entries, read_corpus
from leafledger.sources.sinks import write_bundle
from leafledger.streaming import incremental, late
from leafledger.streaming import stats as ST
from leafledger.session import shared_dir

AS_OF = dt.datetime(2024, 3, 1)
EXTENSIONS = "md, txt, .go,py"
EXCLUDE = "doc_1*, src3/*/*, *.html"
BUDGET = 1_000_000
CONVERSATION_BUDGET = 1500
SMALL_FILE = "8KB"
LARGE_FILE = "10KB"
QUOTAS = ("512B", "2KB", " 4 kb ", "1MB", "0", "1.5MB", "-1MB", "", "1TB", "3000")

TOTALS = ("total_files", "total_directories", "total_size_bytes", "estimated_tokens", "text_files", "binary_files", "truncated")
DOCUMENT_TOTALS = ", ".join(f"{n} {'boolean' if n == 'truncated' else 'long'}" for n in TOTALS)
DOCUMENT_FILE = (
    "path string, size_bytes long, line_count long, extension string, content string, skipped boolean, skip_reason string, truncated boolean"
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _union(spark: SparkSession, sf: str) -> DataFrame:
    columns = ["relpath", "size_bytes", "text"]
    return D.corpus(spark, sf).select(columns).unionByName(D.page_corpus(spark, sf).select(columns))


def _facts(spark: SparkSession, sf: str, *only: str) -> DataFrame:
    return S.facts(_union(spark, sf), only=only)


def _line_facts(spark: SparkSession, sf: str) -> DataFrame:
    return S.facts(_union(spark, sf))


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    return paths.derive_entries(D.corpus(spark, sf))


def _rules(spark: SparkSession, sf: str) -> DataFrame:
    return ignore.rules_of_lines(D.rule_lines(spark, sf))


def _spec(spark: SparkSession, sf: str) -> select.Selection:
    return select.Selection(
        extensions=EXTENSIONS, exclude=EXCLUDE, tracked=D.tracked(spark, sf),
        rules=_rules(spark, sf), max_file_size=SMALL_FILE,
    )


def _folder():
    """The folder of a written text file; the file's own name is Spark's."""
    return F.regexp_extract("relpath", "^folder=([^/]+)", 1)


# -- paths and selection -----------------------------------------------------


@query
def entries(spark, sf):
    return _entries(spark, sf)


@query
def path_columns(spark, sf):
    return paths.with_path_columns(D.corpus(spark, sf).select("relpath")).drop("ext_key")


@query
def filter_dotfiles(spark, sf):
    return select.filter_dotfiles(D.corpus(spark, sf)).select("relpath")


@query
def filter_extensions(spark, sf):
    return select.filter_extensions(D.corpus(spark, sf), EXTENSIONS).select("relpath")


@query
def exclude_globs(spark, sf):
    return select.exclude_globs(D.corpus(spark, sf), EXCLUDE).select("relpath")


@query
def tracked_only(spark, sf):
    return select.tracked_only(D.corpus(spark, sf), D.tracked(spark, sf)).select("relpath", "size_bytes")


@query
def ignore_rules(spark, sf):
    return ignore.parse_ignore_rules(D.rule_lines(spark, sf))


@query
def ignore_rules_apply(spark, sf):
    judged = ignore.apply_ignore_rules(_entries(spark, sf), _rules(spark, sf))
    return judged.select("relpath", "is_dir", "is_ignored")


@query
def ignore_rules_scoped(spark, sf):
    rules = ignore.rules_of_lines(D.scoped_rule_lines(spark, sf), scoped=True)
    return ignore.apply_ignore_rules(_entries(spark, sf), rules).select("relpath", "is_dir", "is_ignored")


@query
def max_size(spark, sf):
    return select.max_size(D.corpus(spark, sf), "2KB").select("relpath", "size_bytes")


@query
def size_quota(spark, sf):
    number = F.substring("source", 4, 9).cast("int")
    choices = F.array(*map(F.lit, QUOTAS))
    quota = F.element_at(choices, F.pmod(number, F.lit(len(QUOTAS))) + 1)
    sources = D.table(spark, sf, "documents").select("source").distinct()
    quotas = sources.select("source", quota.alias("quota"))
    kept = select.quota_join(D.corpus(spark, sf), quotas, "source")
    return kept.select("relpath", "size_bytes", "quota_bytes", "quota_invalid")


@query
def classify_text(spark, sf):
    return select.classify_text(D.sniff_corpus(spark, sf)).select("relpath", "is_text")


@query
def nul_sniff(spark, sf):
    return select.nul_sniff(D.sniff_corpus(spark, sf)).select("relpath", "is_binary")


@query
def select_files(spark, sf):
    return select.select_files(D.corpus(spark, sf), _spec(spark, sf)).select("relpath", "size_bytes", "text")


@query
def selection_audit(spark, sf):
    return select.selection_audit(D.sniff_corpus(spark, sf), _spec(spark, sf))


@query
def dry_run_manifest(spark, sf):
    return select.dry_run_manifest(D.sniff_corpus(spark, sf), select.Selection(exclude=EXCLUDE))


# -- lines and tokens --------------------------------------------------------


@query
def split_lines(spark, sf):
    return lines.split_lines(_union(spark, sf)).select("relpath", "line_no", "line", "line_too_long")


@query
def line_count(spark, sf):
    return lines.line_count(_union(spark, sf)).select("relpath", "line_count")


@query
def classify_lines(spark, sf):
    return lines.classify_lines(_union(spark, sf)).select("relpath", "line_no", "kind")


@query
def classify_line_rows(spark, sf):
    rows = lines.split_lines(D.page_corpus(spark, sf))
    return lines.classify_line_rows(rows).select("relpath", "line_no", "kind")


@query
def classify_blocks(spark, sf):
    return blocks.classify_blocks(D.page_blocks(spark, sf)).select("relpath", "line_no", "kind")


@query
def block_metrics(spark, sf):
    return blocks.block_metrics(D.page_blocks(spark, sf))


@query
def read_lines(spark, sf):
    rows = textlines.read_lines(spark, D.text_folders(spark, sf)).where("relpath <> '_SUCCESS'")
    return rows.select(_folder().alias("folder"), "line_no", "line")


@query
def read_files(spark, sf):
    files = read_corpus(spark, D.text_folders(spark, sf)).where("relpath <> '_SUCCESS'")
    return files.select(_folder().alias("folder"), "size_bytes", F.sha2("content", 256).alias("content_sha256"))


@query
def list_files(spark, sf):
    found = list_entries(spark, D.text_folders(spark, sf)).where("relpath <> '_SUCCESS'")
    size = F.when(~F.col("is_dir"), F.col("size_bytes"))
    return found.select(_folder().alias("folder"), "depth", "is_dir", size.alias("size_bytes"), (F.col("parent") == "").alias("at_top"))


@query
def file_metrics(spark, sf):
    return lines.file_metrics(_union(spark, sf))


@query
def number_lines(spark, sf):
    rows = lines.split_lines(D.corpus(spark, sf))
    return lines.number_lines(rows).select("relpath", "line_no", "numbered")


def _line_tokens(spark, sf, tokens):
    rows = lines.split_lines(_union(spark, sf))
    return rows.select("relpath", "line_no", tokens(F.col("line")).alias("tokens"))


@query
def tokens_code(spark, sf):
    return _line_tokens(spark, sf, T.code_tokens)


@query
def tokens_data(spark, sf):
    return _line_tokens(spark, sf, T.data_tokens)


@query
def tokens_text(spark, sf):
    return _line_tokens(spark, sf, T.text_tokens)


@query
def tokens_default(spark, sf):
    return _line_tokens(spark, sf, T.default_tokens)


@query
def estimate_tokens(spark, sf):
    return _facts(spark, sf, "tokens").select("relpath", "tokens")


@query
def tokens_rough(spark, sf):
    return D.corpus(spark, sf).agg(F.sum(T.rough_tokens(F.col("size_bytes"))).alias("tokens"))


# -- statistics --------------------------------------------------------------


@query
def basic_stats(spark, sf):
    return S.basic_stats(S.facts(D.sniff_corpus(spark, sf), with_lines=False))


@query
def directory_count(spark, sf):
    return S.directory_count(_entries(spark, sf))


@query
def average_file_size(spark, sf):
    return S.average_file_size(_facts(spark, sf, "size_bytes"))


@query
def extension_topk(spark, sf):
    return S.extension_counts(_facts(spark, sf, "ext", "size_bytes"), 5)


@query
def size_distribution(spark, sf):
    return S.size_distribution(_facts(spark, sf, "size_bucket"))


@query
def mtime_distribution(spark, sf):
    return S.mtime_distribution(S.facts(D.corpus(spark, sf), AS_OF, only=("mtime", "age_bucket")))


@query
def complexity_totals(spark, sf):
    return S.complexity_totals(_line_facts(spark, sf))


@query
def language_metrics(spark, sf):
    return S.language_metrics(_line_facts(spark, sf))


@query
def complex_files(spark, sf):
    return S.complex_files(_line_facts(spark, sf))


@query
def language_stats(spark, sf):
    return S.language_stats(_facts(spark, sf, "ext_key", "size_bytes"))


@query
def language_extensions(spark, sf):
    return S.language_extensions(_facts(spark, sf, "ext_key", "size_bytes"))


@query
def top_languages(spark, sf):
    return S.top_languages(_facts(spark, sf, "ext_key", "size_bytes"), 4)


@query
def presence_checks(spark, sf):
    return health.presence_checks(paths.derive_entries(D.project_corpus(spark, sf)), by_top=True)


@query
def large_files(spark, sf):
    return health.large_files(D.corpus(spark, sf), LARGE_FILE)


@query
def empty_directories(spark, sf):
    return health.empty_directories(D.with_empty_directories(_entries(spark, sf)))


@query
def health_check(spark, sf):
    files = D.project_corpus(spark, sf)
    listed = D.with_empty_directories(paths.derive_entries(files))
    checked = health.health_check(files, listed, LARGE_FILE, by_top=True)
    return checked.withColumn("warnings", F.array_join("warnings", "; "))


@query
def profile_report(spark, sf):
    return E.report(D.corpus(spark, sf), AS_OF)


# -- order and budget --------------------------------------------------------


@query
def tree_order(spark, sf):
    return tree.tree_order(_entries(spark, sf)).select("relpath", "is_dir", "position")


@query
def render_tree(spark, sf):
    return tree.render_tree(_entries(spark, sf)).select("relpath", "is_dir", "line")


@query
def budget_cut(spark, sf):
    cut = budget.budget_cut(D.corpus(spark, sf), BUDGET, max_file=SMALL_FILE)
    return cut.select("relpath", "line_no", "line")


@query
def truncation_rows(spark, sf):
    return budget.truncation_rows(D.corpus(spark, sf), BUDGET, max_file=SMALL_FILE)


@query
def too_large_rows(spark, sf):
    return budget.too_large_rows(D.corpus(spark, sf), SMALL_FILE)


@query
def budget_by_conversation(spark, sf):
    turns = D.table(spark, sf, "conversations")
    kept = budget.budget_by(
        turns, CONVERSATION_BUDGET, "conv_id", ["turn"], F.octet_length("text").cast("long")
    )
    return kept.select("conv_id", "turn", "role", "text", "running")


# -- change status -----------------------------------------------------------


@query
def file_status(spark, sf):
    return G.file_status(D.tracked(spark, sf), D.status(spark, sf))


@query
def status_summary(spark, sf):
    return G.status_summary(file_status(spark, sf))


@query
def changed_files(spark, sf):
    return G.changed_files(file_status(spark, sf))


@query
def parse_porcelain(spark, sf):
    report = D.status(spark, sf).select(F.concat("xy", F.lit(" "), "path").alias("value"))
    return G.parse_porcelain(report)


# -- rendering ---------------------------------------------------------------


@query
def render_text(spark, sf):
    return render.render_text(D.corpus(spark, sf))


@query
def render_markdown(spark, sf):
    return render.render_markdown(_union(spark, sf))


@query
def render_html(spark, sf):
    return render.render_html(_union(spark, sf))


@query
def export_files(spark, sf):
    spec = select.Selection(exclude=EXCLUDE)
    return render.export_files(D.sniff_corpus(spark, sf), "corpus", spec, limit=BUDGET, max_file=SMALL_FILE)


@query
def export_metadata(spark, sf):
    files = D.corpus(spark, sf)
    row = render.export_metadata(
        S.basic_stats(S.facts(files, with_lines=False)), S.directory_count(paths.derive_entries(files)), files,
        target="corpus", extensions=EXTENSIONS, max_file_size=SMALL_FILE, character_limit=BUDGET,
    )
    return row.select(
        "target_directory", "total_files", "total_directories", "total_size_bytes",
        "estimated_tokens", "text_files", "binary_files", "truncated",
        F.array_join("options.extensions_filter", ",").alias("extensions_filter"),
        "options.max_file_size", "options.character_limit",
    )


def _bundle(spark, sf, format: str, **limits) -> DataFrame:
    packed = B.bundle(D.corpus(spark, sf), select.Selection(exclude=EXCLUDE), format, **limits)
    return packed.select("section", "relpath", "block")


@query
def bundle(spark, sf):
    return _bundle(spark, sf, "text", limit=BUDGET, max_file=SMALL_FILE)


@query
def bundle_markdown(spark, sf):
    return _bundle(spark, sf, "markdown")


@query
def bundle_html(spark, sf):
    return _bundle(spark, sf, "html")


@query
def bundle_json(spark, sf):
    return _bundle(spark, sf, "json")


@query
def bundle_written(spark, sf):
    """The lines of the written text bundle and how often each stands in it."""
    out = f"{shared_dir(spark)}/bundle-{uuid.uuid4().hex}"
    packed = B.bundle(D.corpus(spark, sf), select.Selection(exclude=EXCLUDE), limit=BUDGET, max_file=SMALL_FILE)
    write_bundle(packed, out)
    lines_of = spark.read.option("lineSep", "\n").text(out).groupBy(F.col("value").alias("line"))
    return lines_of.agg(F.count("*").alias("n"))


@query
def json_document(spark, sf):
    """What stands in the written document: totals, lines of the tree and a record per file."""
    out = f"{shared_dir(spark)}/document-{uuid.uuid4().hex}"
    spec = select.Selection(exclude=EXCLUDE)
    document.write_json_document(
        document.json_blocks(D.sniff_corpus(spark, sf), spec, BUDGET, SMALL_FILE, root="corpus"), out, part_bytes=1 << 20)
    lines_of = document.read_json_document(spark, out)
    file = F.from_json(F.ltrim(F.col("line"), F.lit(",")), DOCUMENT_FILE)
    kept = [F.col(f"f.{n}").cast("string") for n in ("size_bytes", "line_count", "extension", "skipped", "skip_reason", "truncated")]
    files = lines_of.where(F.col("section") == document.FILES).select(file.alias("f")).select(
        F.lit("file").alias("kind"), F.col("f.path").alias("name"),
        F.concat_ws("|", *kept, F.sha2(F.col("f.content").cast("binary"), 256)).alias("value"))
    total = F.from_json(F.regexp_extract("line", '^\\{"metadata": (.*),$', 1), DOCUMENT_TOTALS)
    totals = lines_of.where(F.col("section") == document.HEAD).select(total.alias("t"))
    totals = totals.select(F.explode(F.array(*[
        F.struct(F.lit("total").alias("kind"), F.lit(n).alias("name"), F.col(f"t.{n}").cast("string").alias("value")) for n in TOTALS]))).select("col.*")
    drawn = F.regexp_replace("line", '^"directory_tree": "', "")
    tree_of = lines_of.where(F.col("section") == document.TREE).select(F.lit("tree").alias("kind"), drawn.alias("name"), F.lit("").alias("value"))
    return files.union(totals).union(tree_of)


# -- streaming ---------------------------------------------------------------


def _arriving(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus as a stream over the documents' files."""
    documents = D.table(spark, sf, "documents")
    stream = spark.readStream.schema(documents.schema)
    arriving = stream.option("pathGlobFilter", "*.parquet").parquet(f"{sf}/documents.parquet*")
    return spark.sql(f"SELECT {D.CORPUS} FROM {{docs}}", docs=arriving)


def _drained(frame: DataFrame, name: str, keys: list[str]) -> DataFrame:
    folder = f"{shared_dir(frame.sparkSession)}/{name}-{uuid.uuid4().hex}"
    return ST.drain(frame, folder, keys)


@query
def corpus_growth(spark, sf):
    """All windows, from a stream that is drained into the cluster's shared folder."""
    return _drained(ST.corpus_growth(_arriving(spark, sf), delay=None), "growth", ["window_start", "window_end"])


@query
def corpus_stats_stream(spark, sf):
    return _drained(ST.corpus_stats_stream(_arriving(spark, sf)), "running", ["extension"])


def _arrived_in_batches(spark: SparkSession, sf: str) -> str:
    """The corpus taken in as three batches; the second brings a time far in the future."""
    folder = f"{shared_dir(spark)}/late-{uuid.uuid4().hex}"
    files = D.corpus(spark, sf).select("doc_id", "relpath", "size_bytes", "mtime", "text")
    sentinel = spark.sql("SELECT -2L AS doc_id, 'end' AS relpath, 0L AS size_bytes, timestamp_ntz'2099-01-01 00:00:00' AS mtime, '' AS text")
    for number in range(3):
        batch = files.where(F.col("doc_id") % 3 == number)
        (batch.union(sentinel) if number == 1 else batch).drop("doc_id").write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(files.drop("doc_id").schema).parquet(f"{folder}/in")
        late.drain_growth(stream, folder)
    return folder


@query
def growth_closed(spark, sf):
    found = late.windows(spark, _arrived_in_batches(spark, sf))
    return found.select(
        ST.local(F.col("window_start")).alias("window_start"), ST.local(F.col("window_end")).alias("window_end"),
        "files", "size_bytes", "tokens", "is_closed")


@query
def growth_late(spark, sf):
    return late.late_rows(spark, _arrived_in_batches(spark, sf)).drop("batch")


@query
def profile_incremental(spark, sf):
    """The report of a corpus that arrives whole, is changed in part and loses some files."""
    folder = f"{shared_dir(spark)}/incremental-{uuid.uuid4().hex}"
    files = D.corpus(spark, sf)
    text = F.when(F.col("doc_id") % 3 == 0, F.lit("changed")).otherwise(F.concat("text", F.lit("\n"), "text"))
    older = files.withColumn("text", text).withColumn("size_bytes", F.octet_length("text").cast("long"))
    incremental.take_in(older, folder, 0, AS_OF)
    some = files.where("doc_id % 3 = 0").withColumn("is_gone", F.col("doc_id") % 15 == 0)
    incremental.take_in(some, folder, 1, AS_OF, F.col("is_gone"))
    incremental.take_in(files.where("doc_id % 3 > 0 OR doc_id % 30 = 0"), folder, 2, AS_OF)
    merged = f"{folder}-merged"
    incremental.compact(spark, folder, merged, 2)
    return S.profile_report(incremental.condensed(spark, merged))
