"""WARC archives: range-sorted shards, files rolled by compressed size, committed by manifest."""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafledger.llm.shared import col, scratch
from leafledger.operators.running import key_bounds, with_range

#: Compressed bytes after which a shard goes on in a new file.
ROLL_BYTES = 4 << 20
#: Payload bytes a shard should hold.
SHARD_BYTES = 16 << 20
#: Shards at most, each a range of ids; beyond that shards grow.
MAX_SHARDS = 1 << 16
DATE = "2024-03-01T00:00:00Z"
_read_columns = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, digest_ok boolean"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header(fields: list[tuple[str, str]]) -> bytes:
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + b"\r\n"


def _one_line(value: str) -> str:
    """A header value without line breaks."""
    return "".join(" " if c in "\r\n" else c for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, is_revisit: bool) -> bytes:
    """One record; lengths and digests are always made from the payload at hand."""
    name = "none" if page_id is None else str(page_id)
    fields = [
        ("WARC-Type", "revisit" if is_revisit else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name} {url} {digest}')}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _one_line(url or "")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Page-ID", name),
        ("Payload-Length", str(len(payload))),
    ]
    if is_revisit:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("Refers-To-Page", "none" if refers_to is None else str(refers_to)),
        ]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if is_revisit else http + payload
    fields += [
        ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return _header(fields) + block + b"\r\n\r\n"


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


class _Shard:
    """Files of one shard; each has a temporary name that no other attempt uses."""

    def __init__(self, folder: str, shard: int, roll: int) -> None:
        self.fs, self.path = _filesystem(folder)
        self.shard, self.roll, self.seq = shard, roll, 0
        self.attempt, self.out, self.done = uuid.uuid4().hex, None, []

    def write(self, data: bytes) -> None:
        packed = gzip.compress(data, compresslevel=6, mtime=0)
        if self.out is not None and self.size + len(packed) > self.roll:
            self.close()
        if self.out is None:
            self.name = f"shard-{self.shard:08d}-{self.seq:05d}.warc.gz"
            self.temporary = f"_temporary-{self.name}-{self.attempt}"
            self.out, self.size, self.records, self.sha = self.fs.open_output_stream(f"{self.path}/{self.temporary}"), 0, 0, hashlib.sha256()
        self.out.write(packed)
        self.sha.update(packed)
        self.size += len(packed)
        self.records += 1

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        self.done.append((self.name, self.temporary, self.records, self.size, self.sha.hexdigest()))
        self.out, self.seq = None, self.seq + 1


_MANIFEST = "name string, temporary string, records long, bytes long, sha256 string"


def _files(done: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*done))
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["name", "temporary", "records", "bytes", "sha256"])


def _write(folder: str, roll: int):
    """Rows come by shard, id and digest, the note on an equal payload before its page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, note, used = None, (None, None, None), False
        for batch in batches:
            for shard, page_id, digest, is_page, latest, url, html in zip(*batch.columns):
                shard, page_id, digest = shard.as_py(), page_id.as_py(), digest.as_py()
                if open_ is None or open_.shard != shard:
                    if open_ is not None:
                        open_.close()
                        yield _files(open_.done)
                    open_ = _Shard(folder, shard, roll)
                if not is_page.as_py():
                    note, used = (page_id, digest, latest.as_py()), False
                    continue
                known = note[:2] == (page_id, digest)
                first = known and note[2] == page_id and not used
                is_revisit = known and not first
                used = used or first
                payload = (html.as_py() or "").encode()
                refers_to = note[2] if is_revisit else None
                open_.write(record(page_id, url.as_py(), payload, sha1_base32(payload), refers_to, is_revisit))
        if open_ is not None:
            open_.close()
            if open_.done:
                yield _files(open_.done)

    return run


def _shards(narrow: DataFrame, target: int) -> int:
    """As many shards as the payloads need; one number reaches the driver."""
    total = narrow.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size")).head().size
    return min(MAX_SHARDS, max(1, -(-total // target)))


def _placed(rows: DataFrame, narrow: DataFrame, shards: int) -> DataFrame:
    """``rows`` with their shard, a range of ids and digests cut at quantiles of a sample.

    The sample is that of the least hashes, so the same pages give the same ranges. The borders
    are a subquery, 40 bytes a shard.
    """
    order = ["page_id", "digest"]
    return with_range(rows, order, key_bounds(narrow, order, shards), "shard") if shards > 1 else rows.withColumn("shard", F.lit(0))


def _commit(folder: str):
    """Gives a file its final name; a file that has it already is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _filesystem(folder)
        for batch in batches:
            for name, temporary in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                source = f"{path}/{temporary}"
                if fs.get_file_info(source).type != pafs.FileType.NotFound:
                    fs.move(source, f"{path}/{name}")
            yield batch

    return run


def write_archives(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) below ``folder`` and returns the manifest.

    Of pages with equal payloads that with the largest id is written whole and the others
    refer to it; among rows that repeat an id with its payload the first is whole. A null
    text is an empty payload, a null id sorts first and a null url is empty; no other column
    is looked at. Shards are ranges of ids and digests whose borders follow from the pages alone,
    so the same pages give the same bytes. The number of jobs does not grow with the pages. Each attempt of a task writes under names of its own; only
    files that its successful end reports enter the manifest, get their final name, and are
    read. An empty table gives an empty manifest.
    """
    spark = pages.sparkSession
    html = F.coalesce(col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    narrow = rows.select("page_id", "digest", F.octet_length("html").cast("long").alias("size"))
    again = narrow.groupBy("digest").agg(F.max("page_id").alias("latest"), F.count("*").alias("n")).where("n > 1")
    notes = narrow.select("page_id", "digest").distinct().join(again, "digest")
    shards = _shards(narrow, shard_bytes)
    # twice as many tasks as shards, so that few tasks get several
    tasks = max(2 * shards, spark.sparkContext.defaultParallelism)
    none = F.lit(None).cast("string")
    both = rows.select("page_id", "digest", F.lit(True).alias("is_page"), F.lit(None).cast("long").alias("latest"), "url", "html")
    both = both.union(notes.select("page_id", "digest", F.lit(False), "latest", none, none))
    both = _placed(both, narrow, shards).select("shard", *both.columns)
    dealt = both.repartition(tasks, "shard").sortWithinPartitions("shard", "page_id", "digest", "is_page", "url")
    _filesystem(folder)[0].create_dir(_filesystem(folder)[1], recursive=True)
    pending = f"{folder}/_pending"
    dealt.mapInArrow(_write(folder, roll_bytes), _MANIFEST).write.parquet(pending)
    manifest = spark.read.schema(_MANIFEST).parquet(pending)
    manifest.mapInArrow(_commit(folder), _MANIFEST).write.parquet(f"{folder}/_manifest")
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/_manifest")


def _records(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """Header fields and block of each record, one compressed member at a time."""
    view = memoryview(data)
    while len(view):
        member = zlib.decompressobj(wbits=31)
        raw = member.decompress(view) + member.flush()
        view = view[len(view) - len(member.unused_data) :]
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        yield fields, rest[: int(fields["Content-Length"])]


def _row(fields: dict, block: bytes) -> tuple:
    """What a record says, and whether its digests and lengths are those of its bytes."""
    number = lambda v: None if v in (None, "none") else int(v)
    is_revisit = fields["WARC-Type"] == "revisit"
    payload = block.partition(b"\r\n\r\n")[2]
    stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    sound = sha1_base32(block) == fields["WARC-Block-Digest"].removeprefix("sha1:")
    sound = sound and (is_revisit or (sha1_base32(payload) == stated and len(payload) == int(fields["Payload-Length"])))
    return (
        number(fields["Page-ID"]), int(fields["Payload-Length"]) if is_revisit else len(payload), stated, fields["WARC-Type"],
        number(fields.get("Refers-To-Page")), sound,
    )


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _read_columns.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
    for batch in batches:
        for content in batch.column(0):
            rows = [_row(f, b) for f, b in _records(content.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``,
    ``digest_ok`` of every record in the files that the manifest names.

    Raises an error if a file is missing, is not in the manifest or has another length.
    """
    manifest = spark.read.schema(_MANIFEST).parquet(f"{folder}/_manifest")
    schema = T._parse_datatype_string("path string, modificationTime timestamp, length long, content binary")
    files = spark.read.format("binaryFile").schema(schema).option("pathGlobFilter", "shard-*.warc.gz").load(folder)
    there = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")
    apart = there.join(manifest.select("name", "bytes"), "name", "full_outer").where("NOT length <=> bytes")
    if wrong := apart.limit(3).collect():
        raise ValueError(f"archives differ from their manifest: {[r.name for r in wrong]}")
    return files.select("content").mapInArrow(_read, _read_columns)


def sound(records: DataFrame) -> DataFrame:
    """Records read back, without ``digest_ok``; a record whose digests do not hold raises an error."""
    broken = F.raise_error(F.concat(F.lit("damaged record of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("none"))))
    checked = F.when(F.col("digest_ok"), F.col("payload_digest")).otherwise(broken.cast("string"))
    return records.withColumn("payload_digest", checked).drop("digest_ok")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes archives to a new place in the shared folder and reads them back, each record checked."""
    folder = scratch(pages.sparkSession, "warc")
    write_archives(pages, folder)
    return sound(read_archives(pages.sparkSession, folder))
