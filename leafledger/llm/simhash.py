"""SimHash near-duplicates: popcount cells per segment, a grid join, exact verification."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafledger.llm.components import connected_components
from leafledger.llm.forest import Forest
from leafledger.llm.shared import col, free_name, stored

SEED = 42
#: Pairs compared at once; bounds a task's memory whatever a cell holds.
BLOCK = 1 << 21
#: Shingles whose bits are counted at once.
SHINGLE_BLOCK = 1 << 16


def fingerprint_of(text: str | None, shingle: int) -> int:
    """The 64-bit SimHash of a text: a bit is set if over half the shingle hashes set it."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    width = min(shingle, len(words))
    ones, total = np.zeros(64, np.int64), 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(width))))
    while True:
        part = itertools.islice(grams, SHINGLE_BLOCK)
        hashes = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in part), np.uint64)
        if not hashes.size:
            break
        total += hashes.size
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits((2 * ones > total).astype(np.uint8), bitorder="little")
    return int(bits.view(np.int64)[0])


def _printed(rows: DataFrame, shingle: int) -> DataFrame:
    """``rows`` with their last column, a text, replaced by its ``fingerprint``, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint_of(t.as_py(), shingle) for t in batch.columns[-1]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prints, pa.int64())], [*batch.schema.names[:-1], "fingerprint"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField("fingerprint", T.LongType())]))


def fingerprints(docs: DataFrame, shingle: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id``, ``fingerprint`` (long), one row per row of ``docs``, without a shuffle."""
    return _printed(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text")), shingle)


def _bounds(segments: int) -> list[int]:
    return [round(i * 64 / segments) for i in range(segments + 1)]


def _popcounts(prints: np.ndarray, segments: int) -> np.ndarray:
    cuts = _bounds(segments)
    parts = [(prints >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1) for lo, hi in zip(cuts, cuts[1:])]
    return np.stack([np.bitwise_count(p) for p in parts], axis=1).astype(np.int64)


def _steps(segments: int, distance: int) -> np.ndarray:
    """Half of the offsets within the Manhattan distance: those whose first step is upwards."""
    found = []

    def extend(prefix: list[int], left: int) -> None:
        if len(prefix) == segments:
            if next((x for x in prefix if x), 0) > 0:
                found.append(list(prefix))
            return
        for x in range(-left, left + 1):
            extend(prefix + [x], left - abs(x))

    extend([], distance)
    return np.array(found, np.int64).reshape(-1, segments)


def _grid(segments: int) -> tuple[np.ndarray, np.ndarray]:
    widths = np.diff(_bounds(segments))
    return widths, np.concatenate([[1], np.cumprod(widths[::-1] + 1)[:-1]])[::-1].astype(np.int64)


def _cells(segments: int, distance: int):
    """Each fingerprint goes to its own cell and to the cells above it within the distance."""
    widths, weights = _grid(segments)
    steps = _steps(segments, distance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for start in range(0, prints.size, 1 << 13):
                part = prints[start : start + (1 << 13)]
                home = _popcounts(part, segments)
                keys, owners = [(home @ weights) * 2], [np.arange(part.size)]
                for step in steps:
                    moved = home + step
                    inside = np.nonzero(((moved >= 0) & (moved <= widths)).all(axis=1))[0]
                    keys.append((moved[inside] @ weights) * 2 + 1)
                    owners.append(inside)
                key, owner = np.concatenate(keys), np.concatenate(owners)
                order = np.argsort(key, kind="stable")
                key, values = key[order], part[owner[order]]
                first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if key.size else np.empty(0, np.int64)
                blobs = [v.tobytes() for v in np.split(values, first[1:])] if key.size else []
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[first] >> 1, pa.int64()), pa.array((key[first] & 1).astype(bool)), pa.array(blobs, pa.binary())],
                    ["cell", "visitor", "prints"],
                )

    return run


def forest_of_cell(home: np.ndarray, visitors: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one cell as a star per linked group, never as all pairs of a group."""
    everyone = np.concatenate([home, visitors])
    forest = Forest(everyone.size)
    width = max(1, min(everyone.size, BLOCK))
    rows = max(1, BLOCK // width)
    for top in range(0, home.size, rows):
        upper = home[top : top + rows]
        for left in range(top, everyone.size, width):
            near = np.bitwise_count(upper[:, None] ^ everyone[None, left : left + width]) <= distance
            i, j = np.nonzero(near)
            i, j = i + top, j + left
            forest.link(i[i < j], j[i < j])
    linked, smallest = forest.stars()
    return everyone[linked], everyone[smallest]


def _verify(distance: int):
    """Rows come sorted by cell, residents first; a cell is compared block by block."""

    def close(home: list[bytes], visitors: list[bytes]) -> pa.RecordBatch:
        residents = np.frombuffer(b"".join(home), np.uint64)
        a, b = forest_of_cell(residents, np.frombuffer(b"".join(visitors), np.uint64), distance)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, home, visitors = None, [], []
        for batch in batches:
            for cell, visitor, prints in zip(*(c.to_pylist() for c in batch.columns)):
                if cell != current:
                    if home:
                        yield close(home, visitors)
                    current, home, visitors = cell, [], []
                if visitor and not home:
                    continue  # nobody lives there
                (visitors if visitor else home).append(prints)
        if home:
            yield close(home, visitors)

    return run


def near_links(prints: DataFrame, distance: int = 3, segments: int = 5) -> DataFrame:
    """Links ``a``, ``b`` that join all distinct fingerprints of ``prints`` within the distance.

    The popcount of a segment changes by one per bit, so the Manhattan distance of popcount
    vectors is at most the number of differing bits: partners lie in cells within that
    distance. What a cell finds leaves it as a star per group of linked fingerprints.
    """
    cells = prints.select("fingerprint").mapInArrow(_cells(segments, distance), "cell long, visitor boolean, prints binary")
    dealt = cells.repartition("cell").sortWithinPartitions("cell", "visitor")
    return dealt.mapInArrow(_verify(distance), "a long, b long")


def simhash_groups(
    docs: DataFrame,
    shingle: int = 3,
    distance: int = 3,
    segments: int = 5,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``doc_id``, ``fingerprint`` (long), ``component_id`` per row of ``docs``.

    Texts are lower-cased in A-Z and cut at ASCII white space; texts with fewer words than a
    shingle hash their whole sequence; null, empty and wordless texts have fingerprint zero and
    link like any other. Equal fingerprints are one node, so copies never meet pairwise.
    ``component_id`` is the smallest id reachable, null only where a whole component has null
    ids. Repeated rows and ids keep a row each. An empty table gives an empty result; other
    columns are not looked at.
    """
    marked = stored(fingerprints(docs, shingle, id_column, text_column), "simhash")
    distinct = marked.groupBy("fingerprint").agg(F.min("doc_id").alias("smallest"))
    nodes = connected_components(near_links(distinct, distance, segments), "a", "b")
    linked = nodes.withColumnRenamed("node", "fingerprint").join(distinct, "fingerprint")
    smallest = linked.groupBy("component").agg(F.min("smallest").alias("component_id"))
    labels = linked.join(smallest, "component").select("fingerprint", "component_id")
    named = distinct.join(labels, "fingerprint", "left").select(
        "fingerprint", F.coalesce("component_id", "smallest").alias("component_id")
    )
    return marked.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def keep_one_per_group(
    docs: DataFrame,
    shingle: int = 3,
    distance: int = 3,
    segments: int = 5,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row of ``docs`` per group: the one with the smallest id, null ids last, and of equal
    ids the one with the smallest hash of its text."""
    id_, hash_, text_hash = (free_name(docs.columns, n) for n in ("__kept_id", "__kept_hash", "__text_hash"))
    text = col(text_column).cast("string")
    rows = docs.select(col(id_column).alias("doc_id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    marked = stored(_printed(rows, shingle), "simhash")
    distinct = marked.groupBy("fingerprint").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "hash")).alias("head"))
    nodes = connected_components(near_links(distinct, distance, segments), "a", "b")
    grouped = distinct.join(nodes.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    kept = grouped.groupBy(F.coalesce("component", "fingerprint")).agg(F.min("head").alias("head"))
    kept = kept.select(F.col("head.doc_id").alias(id_), F.col("head.hash").alias(hash_))
    own = docs.withColumn(text_hash, F.xxhash64(text))
    stay = own.join(kept, col(id_column).eqNullSafe(F.col(id_)) & (F.col(text_hash) == F.col(hash_)), "left_semi")
    return stay.dropDuplicates([id_column, text_hash]).select(*[col(c) for c in docs.columns])
