"""Byte-level BPE: overlapping chunks, boundaries that resynchronise, pieces encoded apart."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafledger.llm.shared import free_name, stored

#: Characters of a chunk, and of what it shares with the next one.
CHUNK = 1 << 15
OVERLAP = 1 << 11
#: A boundary is certain only if this many characters after it are visible.
LOOKAHEAD = 2
#: White-space runs from here on are split from the text by the streaming pattern matcher.
LONG_RUN = 1 << 15
#: Characters that one message from a Python worker holds at most, unless one row has more.
MESSAGE = 1 << 22

_long_run = regex.compile(r"\s{%d}" % LONG_RUN)


@functools.lru_cache(maxsize=4)
def _encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode_text(text: str, path: str, pattern: str) -> list[int]:
    """Ids of a text; no special tokens. Lone surrogates become the replacement character."""
    encoding = _encoding(path, pattern)
    if not _long_run.search(text):
        return encoding.encode_ordinary(text)
    ids: list[int] = []
    for match in regex.finditer(pattern, text):
        ids.extend(encoding._encode_single_piece(match[0]))
    return ids


def _encode(path: str, pattern: str, at: int, name: str, decoded: str | None):
    """Adds ids to rows, and the bytes that these stand for; the text column is replaced by them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, held, ids = 0, 0, []
            for i, text in enumerate(batch.column(at)):
                ids.append(encode_text(text.as_py() or "", path, pattern))
                held += len(ids[-1])
                if held > MESSAGE // 4 or i == batch.num_rows - 1:
                    rows = batch.slice(start, len(ids))
                    columns = [*rows.columns, pa.array(ids, pa.list_(pa.int32()))]
                    names = [*rows.schema.names, name]
                    if decoded:
                        whole = _encoding(path, pattern).decode_bytes
                        columns.append(pa.array([whole(x) for x in ids], pa.binary())), names.append(decoded)
                    del columns[at], names[at]
                    yield pa.RecordBatch.from_arrays(columns, names)
                    start, held, ids = i + 1, 0, []

    return run


def _with_ids(df: DataFrame, text_column: str, name: str, path: str, pattern: str, decoded: str | None = None) -> DataFrame:
    at = df.columns.index(text_column)
    fields = [f for f in df.schema.fields if f.name != text_column]
    fields.append(T.StructField(name, T.ArrayType(T.IntegerType())))
    if decoded:
        fields.append(T.StructField(decoded, T.BinaryType()))
    return df.mapInArrow(_encode(path, pattern, at, name, decoded), T.StructType(fields))


def _chunks(chunk: int, overlap: int):
    """Overlapping chunks of each text, a message at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digest, value in zip(batch.column(0), batch.column(1)):
                text, key = value.as_py(), digest.as_py()
                last = max(0, -(-len(text) // chunk) - 1)
                step = max(1, MESSAGE // (chunk + overlap))
                for first in range(0, last + 1, step):
                    seqs = list(range(first, min(first + step, last + 1)))
                    parts = [text[s * chunk : (s + 1) * chunk + (overlap if s < last else 0)] for s in seqs]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key] * len(seqs)), pa.array(seqs, pa.int32()), pa.array([s == last for s in seqs]), pa.array(parts)],
                        ["digest", "seq", "last", "part"],
                    )

    return run


def _boundaries(pattern: str, chunk: int, overlap: int):
    """Per chunk: cut points in what it shares with the chunk before and with the one after.

    A cut point is where a match starts after a character that is not white space: what
    follows is then matched alike whatever stands before, and what ends there looks no further.
    """
    compiled = regex.compile(pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, tails = [], []
            for seq, last, part in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                head, tail = [], []
                for match in compiled.finditer(part):
                    cut = match.end()
                    if cut >= len(part) or part[cut - 1].isspace():
                        continue
                    if cut <= overlap:
                        head.append(seq * chunk + cut)
                    if cut >= chunk and not last and cut + LOOKAHEAD <= len(part):
                        tail.append(seq * chunk + cut)
                heads.append(head), tails.append(tail)
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(heads, lists), pa.array(tails, lists)],
                ["digest", "seq", "last", "heads", "tails"],
            )

    return run


def _piece_ids(chunk: int, path: str, pattern: str):
    """The ids of a piece, whose text is put together from the chunks it lies in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digest, piece, begin, end, parts in zip(*(batch.column(i) for i in range(5))):
                own = parts.as_py()
                text = "".join([p["part"][:chunk] for p in own[:-1]] + [own[-1]["part"]])
                at = own[0]["seq"] * chunk
                stop = None if end.as_py() is None else end.as_py() - at
                ids = encode_text(text[begin.as_py() - at : stop], path, pattern)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([digest.as_py()]), pa.array([piece.as_py()], pa.int32()), pa.array([ids], pa.list_(pa.int32()))],
                    ["digest", "piece", "ids"],
                )

    return run


def encoded_pieces(texts: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """``digest``, ``piece``, ``ids``: distinct long ``texts`` (digest, text) cut where matching is certain.

    Neighbouring chunks match the text apart. From the first cut point that both have found in
    their common part they agree, so the text is cut there; where they have none (a run longer
    than the overlap) the chunks stay together as one piece.
    """
    if chunk < 2 * overlap or overlap <= LOOKAHEAD:
        raise ValueError("chunk must be at least twice the overlap, and the overlap wider than the lookahead")
    parts = texts.mapInArrow(_chunks(chunk, overlap), "digest string, seq int, last boolean, part string")
    parts = stored(parts.repartition("digest", "seq"), "chunks")
    bounds = parts.mapInArrow(
        _boundaries(pattern, chunk, overlap),
        "digest string, seq int, last boolean, heads array<long>, tails array<long>",
    )
    bounds = stored(bounds, "bounds")
    after = bounds.select("digest", (F.col("seq") + 1).alias("seq"), "tails")
    met = bounds.select("digest", "seq", "heads").join(after, ["digest", "seq"], "left")
    met = met.select("digest", "seq", F.array_min(F.array_intersect("heads", "tails")).alias("cut"))
    met = met.withColumn("cut", F.when(F.col("seq") == 0, F.lit(0)).otherwise(F.col("cut")))
    named = met.selectExpr(
        "digest", "seq", "cut", "cast(count(cut) over (partition by digest order by seq) as int) piece"
    )
    starts = named.where("cut is not null").select("digest", "piece", F.col("cut").alias("begin"))
    ends = starts.select("digest", (F.col("piece") - 1).alias("piece"), F.col("begin").alias("end"))
    grouped = (
        parts.select("digest", "seq", "part").join(named.select("digest", "seq", "piece"), ["digest", "seq"])
        .groupBy("digest", "piece").agg(F.sort_array(F.collect_list(F.struct("seq", "part"))).alias("parts"))
    )
    whole = grouped.join(starts, ["digest", "piece"]).join(ends, ["digest", "piece"], "left")
    whole = whole.select("digest", "piece", "begin", "end", "parts")
    return whole.mapInArrow(_piece_ids(chunk, path, pattern), "digest string, piece int, ids array<int>")


def encode(
    docs: DataFrame,
    path: str,
    pattern: str,
    text_column: str = "text",
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
    name: str = "ids",
    decoded: str | None = None,
) -> DataFrame:
    """``docs`` with the text replaced by its token ids, in no order; null texts have none.

    With ``decoded`` a column of that name has the bytes that the ids stand for, as ``decode``
    gives them; short texts are then encoded and decoded in one pass.

    Texts up to a chunk are encoded where they are read. Of longer ones each distinct text is
    cut into pieces that all tasks share, and its rows get the ids by the text's digest;
    repeated rows and null ids thus keep a row each. Only an unbroken run of one kind of
    character makes a piece longer than a chunk, as its merges depend on all of it.
    """
    text, digest = free_name(docs.columns, "__text"), free_name(docs.columns, "__digest")
    name = free_name([c for c in docs.columns if c != text_column], name)
    base = docs.withColumn(text_column, F.coalesce(F.col(text_column).cast("string"), F.lit("")))
    short = base.where(F.length(text_column) <= chunk)
    long = base.where(F.length(text_column) > chunk).withColumn(digest, F.sha2(F.col(text_column).cast("binary"), 256))
    if decoded:
        decoded = free_name([*(c for c in docs.columns if c != text_column), name], decoded)
    done = _with_ids(short, text_column, name, path, pattern, decoded)
    distinct = long.select(F.col(digest).alias("digest"), F.col(text_column).alias("text")).dropDuplicates(["digest"])
    pieces = encoded_pieces(distinct, path, pattern, chunk, overlap)
    joined = pieces.groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("piece", "ids"))).alias("all"))
    joined = joined.select(F.col("digest").alias(digest), F.flatten("all.ids").alias(name))
    rest = long.drop(text_column).join(joined, digest).drop(digest)
    return done.unionByName(decode(rest, path, pattern, name, decoded) if decoded else rest)


def decode(encoded: DataFrame, path: str, pattern: str, ids_column: str = "ids", name: str = "bytes") -> DataFrame:
    """``encoded`` with the bytes that its ids stand for, concatenated; null ids give none."""
    at = encoded.columns.index(ids_column)
    name = free_name(encoded.columns, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(path, pattern)
        for batch in batches:
            start, held, out = 0, 0, []
            for i, ids in enumerate(batch.column(at)):
                out.append(encoding.decode_bytes(ids.values.to_pylist() if ids.is_valid else []))
                held += len(out[-1])
                if held > MESSAGE or i == batch.num_rows - 1:
                    rows = batch.slice(start, len(out))
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(out, pa.binary())], [*rows.schema.names, name])
                    start, held, out = i + 1, 0, []

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField(name, T.BinaryType())]))


def digests(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", **options) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` per row of ``docs``."""
    narrow = docs.select(F.col(id_column).alias("doc_id"), F.col("text").cast("string").alias("text"))
    decoded = encode(narrow, path, pattern, decoded="bytes", **options)
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
