"""Corpora from directories, listed and read by the executors.

A root is a path on a file system that all executors see, or an address such as
``hdfs://...`` or ``s3://...`` that they can open.  Names are bytes: what is not UTF-8 is
shown with escapes, and ``raw`` keeps the bytes so that such files are entered and read too.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafledger.functions import paths as P
from leafledger.operators.paths import entry_columns
from leafledger.schema import require
from leafledger.session import shared_dir

_SCHEME = "^([A-Za-z][A-Za-z0-9+.-]*):"
# Times travel as microseconds.
LISTED = pa.schema(
    [
        ("relpath", pa.string()), ("raw", pa.binary()), ("is_dir", pa.bool_()), ("size_bytes", pa.int64()),
        ("mtime", pa.int64()), ("warning", pa.string()),
    ]
)
LISTED_COLUMNS = "relpath string, raw binary, is_dir boolean, size_bytes long, mtime long, warning string"
#: A listing row, or work left to do: a directory, or ``names`` of one that are to be looked at.
WALKED = LISTED.append(pa.field("todo", pa.bool_())).append(pa.field("names", pa.list_(pa.binary())))
WALKED_COLUMNS = f"{LISTED_COLUMNS}, todo boolean, names array<binary>"
LOADED = pa.schema(
    [
        ("relpath", pa.string()), ("size_bytes", pa.int64()), ("mtime", pa.int64()),
        ("content", pa.binary()), ("warning", pa.string()),
    ]
)
LOADED_COLUMNS = "relpath string, size_bytes long, mtime long, content binary, warning string"
LISTING_BATCH = 10_000
#: Names that a task looks at in the first round; twice as many in each one after.
FIRST_NAMES = 2000
#: Names of one directory that a task looks at; more are dealt out in parts of this size.
PART_NAMES = 5000
LOADING_BATCH_BYTES = 64 * 1024 * 1024


def _local(root: str) -> str | None:
    """The path of a root on a mounted file system, None for any other address."""
    scheme = re.match(_SCHEME, root)
    if scheme and scheme[1] != "file":
        return None
    return os.path.abspath(re.sub("^file:(//[^/]*)?", "", root))


def read_corpus(spark: SparkSession, root: str, include_dotfiles: bool = False) -> DataFrame:
    """Files below ``root`` as ``relpath, size_bytes, mtime, content, warning``.

    Only names with a leading dot are left out, and only without ``include_dotfiles``.  Paths
    are those of ``list_entries``.  A file that cannot be read has null content and a warning.
    """
    return load_contents(list_entries(spark, root, include_dotfiles), root)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    arrays = [pa.array(values, field.type) for values, field in zip(columns, schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _shown(raw: bytes) -> str:
    return raw.decode("utf-8", "backslashreplace")


def _entry(where: bytes, raw: bytes, item: os.DirEntry | None) -> tuple:
    """The row of a name, by what its directory told of it or by its path."""
    is_dir = item.is_dir(follow_symlinks=False) if item else os.path.isdir(where) and not os.path.islink(where)
    try:
        facts = item.stat() if item else os.stat(where)
        return _shown(raw), raw, is_dir, facts.st_size, facts.st_mtime_ns // 1000, None
    except OSError as error:
        return _shown(raw), raw, is_dir, None, None, str(error)


def _scan_mounted(root: bytes, folder: bytes, names: list[bytes] | None, include_dotfiles: bool) -> Iterator[tuple]:
    """Rows of a directory, or of some ``names`` in it; a large directory gives work for others.

    Reading names is one pass that cannot be divided; looking at what they name can.
    """
    where = os.path.join(root, folder) if folder else root

    def below(name: bytes) -> bytes:
        return folder + b"/" + name if folder else name

    if names is not None:
        yield from ((*_entry(os.path.join(where, n), below(n), None), False, None) for n in names)
        return
    try:
        with os.scandir(where) as found:
            items = (i for i in found if include_dotfiles or not i.name.startswith(b"."))
            first = list(itertools.islice(items, PART_NAMES))
            yield from ((*_entry(i.path, below(i.name), i), False, None) for i in first)
            while part := [i.name for i in itertools.islice(items, PART_NAMES)]:
                yield _shown(folder), folder, True, None, None, None, True, part
    except OSError as error:
        yield _shown(folder), folder, True, None, None, str(error), False, None


def _scan_remote(root: str, folder: bytes, include_dotfiles: bool) -> Iterator[tuple]:
    """Rows of a directory in a store, whose listings hold sizes and times already."""
    try:
        store, base = pafs.FileSystem.from_uri(root)
        where = f"{base.rstrip('/')}/{folder.decode()}" if folder else base
        for item in store.get_file_info(pafs.FileSelector(where)):
            if item.base_name.startswith(".") and not include_dotfiles:
                continue
            path = f"{folder.decode()}/{item.base_name}" if folder else item.base_name
            mtime = None if item.mtime_ns is None else item.mtime_ns // 1000
            yield path, path.encode(), item.type == pafs.FileType.Directory, item.size, mtime, None, False, None
    except OSError as error:
        yield _shown(folder), folder, True, None, None, str(error), False, None


def _walk(root: str, include_dotfiles: bool, names: int):
    """A task's walk: whole subtrees, until it has seen about ``names`` names; the rest is work left."""
    mounted = _local(root)

    def scan(folder: bytes, part: list[bytes] | None) -> Iterator[tuple]:
        if mounted is None:
            return _scan_remote(root, folder, include_dotfiles)
        return _scan_mounted(os.fsencode(mounted), folder, part, include_dotfiles)

    def batches(work: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        seen = 0
        for given in work:
            stack = list(zip(given.column("raw").to_pylist(), given.column("names").to_pylist()))
            while stack:
                folder, part = stack.pop()
                if seen >= names:
                    rows.append((_shown(folder), folder, True, None, None, None, True, part))
                else:
                    for row in scan(folder, part):
                        rows.append(row)
                        seen += 1
                        if row[2] and row[5] is None and not row[6]:
                            stack.append((row[1], None))
                        if len(rows) >= LISTING_BATCH:
                            yield _batch(rows, WALKED)
                            rows = []
        yield _batch(rows, WALKED)

    return batches


def _is_directory(root: str) -> bool:
    mounted = _local(root)
    if mounted is not None:
        return os.path.isdir(mounted)
    store, base = pafs.FileSystem.from_uri(root)
    return store.get_file_info(base).type == pafs.FileType.Directory


def _rounds(spark: SparkSession, root: str, include_dotfiles: bool) -> list[DataFrame]:
    """Rounds of a walk, each a checkpointed table of entries and of work left for the next.

    Every task walks subtrees of its own, so that a round is no level of the tree; tasks see
    twice as many names in each round, and the number of rounds grows with the logarithm of
    the names per task.  Work left is dealt out evenly.
    """
    work = spark.createDataFrame([(b"", None)], "raw binary, names array<binary>")
    rounds: list[DataFrame] = []
    while not rounds or not work.isEmpty():
        names = FIRST_NAMES << min(len(rounds), 20)
        dealt = work.repartition(max(1, spark.sparkContext.defaultParallelism))
        rounds.append(dealt.mapInArrow(_walk(root, include_dotfiles, names), WALKED_COLUMNS).checkpoint())
        work = rounds[-1].where("todo").select("raw", "names")
    return rounds


def list_entries(spark: SparkSession, root: str, include_dotfiles: bool = False) -> DataFrame:
    """Every file and directory below ``root``, empty and hidden ones too.

    The executors walk the tree in a few rounds of checkpointed work, see ``_rounds``, so that
    lost executors repeat one round at most.  A directory that cannot be listed yields a
    ``warning`` and no children; a missing root is an error.  ``raw`` has a name's bytes.
    """
    if not _is_directory(root):
        raise NotADirectoryError(f"{root} is not a directory")
    shared_dir(spark)
    found = functools.reduce(DataFrame.unionByName, _rounds(spark, root, include_dotfiles)).where("NOT todo")
    found = found.withColumn("mtime", F.timestamp_micros("mtime"))
    # A directory that failed is listed by its parent as well; the row with the
    # warning replaces that one.
    merged = found.groupBy("relpath", "raw").agg(
        F.bool_or("is_dir").alias("is_dir"),
        F.max("size_bytes").alias("size_bytes"),
        F.max("mtime").alias("mtime"),
        F.max("warning").alias("warning"),
    )
    facts = merged.where("relpath <> ''")
    parts = entry_columns(facts).columns
    named = facts.withColumns({"parent": P.dir_name(F.col("relpath")), "name": P.base_name(F.col("relpath")), "depth": P.depth(F.col("relpath"))})
    return named.select(*parts, "size_bytes", "mtime", "warning", "raw")


def _reader(root: str):
    """A function from a name's bytes to the file's content."""
    mounted = _local(root)
    if mounted is not None:

        def read(raw: bytes) -> bytes:
            with open(os.path.join(os.fsencode(mounted), raw), "rb") as stream:
                return stream.read()

        return read
    store, base = pafs.FileSystem.from_uri(root)

    def fetch(raw: bytes) -> bytes:
        with store.open_input_stream(f"{base.rstrip('/')}/{raw.decode()}") as stream:
            return stream.read()

    return fetch


def load_contents(entries: DataFrame, root: str) -> DataFrame:
    """Contents of the files among ``entries``; an unreadable file keeps its row, with null
    content and a ``warning``."""
    files = require(entries, "relpath", "is_dir", "size_bytes", "mtime").where(~F.col("is_dir"))
    raw = F.col("raw") if "raw" in entries.columns else F.col("relpath").cast("binary")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, rows, held = _reader(root), [], 0
        for batch in batches:
            for path, name, size, mtime in zip(*(batch.column(i).to_pylist() for i in range(4))):
                try:
                    content, warning = read(name), None
                except OSError as error:
                    content, warning = None, str(error)
                rows.append((path, size if content is None else len(content), mtime, content, warning))
                held += len(content or b"")
                if held >= LOADING_BATCH_BYTES:
                    yield _batch(rows, LOADED)
                    rows, held = [], 0
        yield _batch(rows, LOADED)

    narrow = files.select("relpath", raw.alias("raw"), "size_bytes", F.unix_micros("mtime").alias("mtime"))
    return narrow.mapInArrow(load, LOADED_COLUMNS).withColumn("mtime", F.timestamp_micros("mtime"))
