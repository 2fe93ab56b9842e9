"""Embedding near-duplicates: epsilon grid order, blocks of the sequence joined recursively.

What travels to every partner of a block is a sketch of a few bytes a dimension; it tells which
vectors can have a link at all. Only these travel whole, and their cosines decide.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from leafledger.llm.components import connected_components
from leafledger.llm.forest import Forest
from leafledger.llm.shared import col, stored

#: Leading principal dimensions that make up the grid.
GRID_DIMENSIONS = 5
#: Of these, the first ones that blocks are matched by before all are compared.
KEY_DIMENSIONS = 3
#: Least width of the cells for that. They are grid cells where those are not smaller.
KEY_WIDTH = 0.25
#: Vectors of a block (as many as a bitmap has bits), of a part of it whose sketches are multiplied out, and of one whose vectors are.
BLOCK = 32_768
PART = 512
LEAF = 128
#: Sketches travel once per group of blocks: groups that a sequence is cut into, and vectors of one at most.
GROUPS = 10
GROUP_ROWS = 1 << 20
#: Vectors that the principal dimensions are fitted on. Any directions give right results.
FIT_ROWS = 4096
#: Cosines this close to the threshold are computed again with exact sums.
DOUBT = 1e-11
#: More than the rounding of a product of two sketches.
ROUNDING = 1e-5
#: Of a node's number, the bits of its place in the block; the others are the block's.
ROW_BITS = 20

_placed_schema = "dimension int, cell array<int>, vector binary, ids array<long>"
_sequence_schema = "node long, size long, ids array<long>, vector binary, dimension int, block long, n long, lo array<int>, hi array<int>, sketch binary"
_kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}


def _batch(schema: str, rows: int, **columns) -> pa.RecordBatch:
    """A batch of ``schema`` whose other columns are null."""
    fields = [field.split() for field in schema.split(", ")]
    arrays = [pa.array(columns[name], _kinds[kind]) if name in columns else pa.nulls(rows, _kinds[kind]) for name, kind in fields]
    return pa.RecordBatch.from_arrays(arrays, [name for name, _ in fields])


def _usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    return F.coalesce(vector.isNotNull() & ~F.coalesce(bad, F.lit(False)) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled by the largest component first so that squares stay finite."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _width(length: int) -> int:
    """Dimensions of a sketch: what they leave out of a vector is bounded by its norm alone."""
    return min(length, 7 + length // 4)


def principal_dimensions(rows: DataFrame, fit_rows: int) -> dict[int, np.ndarray]:
    """Per vector length, the leading principal directions of a bounded sample.

    The sample has distinct vectors with the smallest of some hashes, so it does not depend on partitions.
    """
    hashed = rows.select("vector", F.xxhash64("vector").alias("hash"))
    distinct = hashed.agg(F.approx_count_distinct("hash")).head()[0]
    some = hashed.where((F.pmod("hash", F.lit(max(1, distinct // (2 * fit_rows)))) == 0) & _usable(F.col("vector"))).distinct()
    by_length: dict[int, list] = {}
    for row in some.orderBy("hash", "vector").limit(fit_rows).collect():
        by_length.setdefault(len(row.vector), []).append(row.vector)
    axes = {}
    for length, vectors in by_length.items():
        units = _unit(np.array(vectors, float))
        _, directions = np.linalg.eigh(np.cov(units, rowvar=False, bias=True).reshape(length, length))
        axes[length] = np.ascontiguousarray(directions[:, ::-1][:, : _width(length)])
    return axes


def _axes(axes: dict[int, np.ndarray], length: int) -> np.ndarray:
    return axes.get(length, np.eye(length)[:, : _width(length)])


def _cells(axes: dict[int, np.ndarray], epsilon: float, kind: np.dtype):
    """Adds the grid cell of each vector, which becomes its bytes. Copies in a batch share a row.

    Vectors that can have no link have dimension 0.
    """

    def alone(ids: pa.Array) -> pa.RecordBatch:
        return _batch(_placed_schema, 1, dimension=[0], cell=[[0] * GRID_DIMENSIONS], vector=[b""], ids=[ids.to_pylist()])

    def placed(ids: pa.Array, values: np.ndarray) -> pa.RecordBatch:
        length = values.shape[1]
        data = pa.py_buffer(np.ascontiguousarray(values).tobytes())
        same = pa.Array.from_buffers(pa.binary(length * kind.itemsize), len(values), [None, data]).dictionary_encode().indices.to_numpy()
        order, starts = np.argsort(same, kind="stable"), np.r_[0, np.cumsum(np.bincount(same))]
        values = values[order[starts[:-1]]]
        cells = np.floor(_unit(values.astype(float)) @ _axes(axes, length)[:, :GRID_DIMENSIONS] / epsilon).astype(np.int32)
        cells = np.pad(cells, ((0, 0), (0, GRID_DIMENSIONS - cells.shape[1])))
        return _batch(
            _placed_schema, len(values), dimension=np.full(len(values), length, np.int32), cell=list(cells), vector=[v.tobytes() for v in values],
            ids=pa.ListArray.from_arrays(pa.array(starts, pa.int32()), ids.take(pa.array(order))),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy()
            for length in np.unique(lengths):
                ids, vectors = batch.filter(pa.array(lengths == length)).columns
                good = np.zeros(len(ids), bool)
                if length:
                    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, length) + kind.type(0)
                    good = np.isfinite(values).all(axis=1) & values.any(axis=1)
                if good.any():
                    yield placed(ids.filter(pa.array(good)), values[good])
                if not good.all():
                    yield alone(ids.filter(pa.array(~good)))

    return run


def _sketch(units: np.ndarray, axes: np.ndarray) -> bytes:
    """The leading coordinates in one byte each, and per vector the norm of what they leave out."""
    places = units @ axes
    scale = (np.maximum(np.abs(places).max(axis=0), 1e-30) / 127).astype(np.float32)
    codes = np.clip(np.rint(places / scale), -127, 127).astype(np.int8)
    kept = codes * scale.astype(float)
    rest = np.sqrt(np.square(units - kept @ axes.T).sum(axis=1)).astype(np.float32)
    error = np.sqrt(np.square(places - kept).sum(axis=1).max())
    return b"".join([np.array(codes.shape, np.int32).tobytes(), np.float32([error * 1.0001]).tobytes(), scale.tobytes(), rest.tobytes(), codes.tobytes()])


class _Sketches:
    """The sketches of a block: rows whose products are, but for ``error``, no less than the cosines."""

    def __init__(self, block: int, dimension: int, data) -> None:
        self.block, self.dimension = block, dimension
        self.size, width = (int(x) for x in np.frombuffer(data, np.int32, 2))
        self.error, scale = float(np.frombuffer(data, np.float32, 1, 8)[0]), np.frombuffer(data, np.float32, width, 12)
        at = 12 + 4 * width
        self.rows = np.empty((self.size, width + 1), np.float32)
        np.multiply(np.frombuffer(data, np.int8, self.size * width, at + 4 * self.size).reshape(self.size, width), scale, out=self.rows[:, :width])
        self.rows[:, width] = np.frombuffer(data, np.float32, self.size, at)
        places, self.starts = self.rows[:, :width], np.arange(0, self.size, PART)
        self.reach = float(np.sqrt(np.square(places).sum(axis=1).max()))
        self.low, self.high = np.minimum.reduceat(places, self.starts), np.maximum.reduceat(places, self.starts)


def _possible(a: _Sketches, b: _Sketches, threshold: float, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of two blocks, or one given twice, the rows that could link to one of the other.

    A cosine is the product of the kept coordinates, that of what was left out (at most the product
    of the norms) and those of coordinates with the errors of others. Parts whose boxes are
    further apart than linked vectors can be are skipped.
    """
    same = a is b
    least = np.float32(threshold - a.error * b.reach - b.error * a.reach - ROUNDING)
    apart = np.maximum(0, np.maximum(a.low[:, None] - b.high, b.low - a.high[:, None]))
    near = np.sqrt(np.square(apart).sum(axis=2)) <= math.sqrt(2 - 2 * threshold) + a.error + b.error + ROUNDING
    of_a, of_b = np.zeros(a.size, bool), np.zeros(b.size, bool)
    for i, k in zip(*np.nonzero(np.triu(near) if same else near)):
        x, y = slice(a.starts[i], a.starts[i] + PART), slice(b.starts[k], b.starts[k] + PART)
        p, q = a.rows[x], b.rows[y]
        bounds = np.matmul(p, q.T, out=space[: len(p) * len(q)].reshape(len(p), len(q)))
        if same and i == k:
            np.fill_diagonal(bounds, -2)
        if bounds.max() >= least:
            possible = bounds >= least
            of_a[x] |= possible.any(axis=1)
            of_b[y] |= possible.any(axis=0)
    return of_a, of_b


def _blocks(block: int, axes: dict[int, np.ndarray], kind: np.dtype):
    """Cuts the sorted sequence into blocks. A row is a class of equal vectors with the ids of its
    members, a block with the range of its cells and its sketches, or the ids of those without links."""

    def close(dimension, number, rows) -> Iterator[pa.RecordBatch]:
        cells, vectors, ids = zip(*rows)
        cells, first = np.array(cells), number << ROW_BITS
        for at in range(0, len(rows), PART):
            some = ids[at : at + PART]
            yield _batch(
                _sequence_schema, len(some), node=np.arange(first + at, first + at + len(some)), size=[len(x) for x in some],
                ids=some, vector=vectors[at : at + PART],
            )
        units = _unit(np.frombuffer(b"".join(vectors), kind).reshape(len(rows), -1).astype(float))
        yield _batch(
            _sequence_schema, 1, dimension=[dimension], block=[number], n=[len(rows)], lo=[cells.min(axis=0).tolist()], hi=[cells.max(axis=0).tolist()],
            sketch=[_sketch(units, _axes(axes, dimension))],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rows, dimension = TaskContext.get().partitionId() << 20, [], None
        for batch in batches:
            for length, cell, vector, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if not length:
                    yield _batch(_sequence_schema, 1, ids=[ids])
                    continue
                if rows and length == dimension and rows[-1][1] == vector:
                    rows[-1][2].extend(ids)
                    continue
                if rows and (len(rows) == block or length != dimension):
                    yield from close(dimension, number, rows)
                    number, rows = number + 1, []
                dimension = length
                rows.append((cell, vector, ids))
        if rows:
            yield from close(dimension, number, rows)

    return run


def _keys(lo: Column, hi: Column, wide: int, margin: int) -> Column:
    """The cells, ``wide`` grid cells each, of the first dimensions that a block's range covers, widened by a margin."""
    keys = F.array(F.array().cast("array<int>"))
    for k in range(KEY_DIMENSIONS):
        ends = (F.floor(F.get(x, k) / wide).cast("int") for x in (lo, hi))
        keys = _extended(keys, F.sequence(next(ends) - margin, next(ends) + margin))
    return keys


def _extended(keys: Column, side: Column) -> Column:
    return F.flatten(F.transform(keys, lambda key: F.transform(side, lambda x: F.concat(key, F.array(x)))))


def _block_pairs(blocks: DataFrame, epsilon: float) -> DataFrame:
    """Pairs of blocks whose cells are neighbours in every grid dimension."""
    ranges, wide = blocks.select("dimension", "block", "lo", "hi"), max(1, math.ceil(KEY_WIDTH / epsilon))
    one = ranges.select("dimension", F.col("block").alias("a"), F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"), F.explode(_keys(F.col("lo"), F.col("hi"), wide, 0)).alias("key"))
    other = ranges.select("dimension", F.col("block").alias("b"), F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"), F.explode(_keys(F.col("lo"), F.col("hi"), wide, 1)).alias("key"))
    near = F.lit(True)
    for k in range(GRID_DIMENSIONS):
        near &= (F.get("a_lo", k) - 1 <= F.get("b_hi", k)) & (F.get("b_lo", k) - 1 <= F.get("a_hi", k))
    met = one.join(other, ["dimension", "key"]).where(near & (F.col("a") <= F.col("b")))
    return met.select("dimension", "a", "b").distinct()


def _tiles(blocks: DataFrame, epsilon: float) -> DataFrame:
    """Blocks with their sketches, dealt to tasks by pairs of groups: ``tile``, ``own`` (a group with itself), ``group``.

    A block goes to at most as many tiles as there are groups, and only where it has a near partner.
    """
    heads = blocks.select("dimension", "block", "n", "lo", "hi")
    total = heads.agg(F.sum("n")).head()[0] or 0
    rows = min(GROUP_ROWS, max(1, math.ceil(total / GROUPS)))
    groups = total // rows + 1
    before = F.sum("n").over(W.Window.orderBy("block").rowsBetween(W.Window.unboundedPreceding, -1))
    grouped = heads.select("block", F.floor(F.coalesce(before, F.lit(0)) / rows).alias("group"))
    side = lambda name: grouped.select(F.col("block").alias(name), F.col("group").alias(f"{name}_group"))
    pairs = _block_pairs(heads, epsilon).join(side("a"), "a").join(side("b"), "b")
    pairs = pairs.withColumn("tile", F.expr("b_group * (b_group + 1) div 2 + a_group")).withColumn("own", F.expr("a_group = b_group"))
    ends = F.explode(F.array(*[F.struct(F.col(x).alias("block"), F.col(f"{x}_group").alias("group")) for x in "ab"]))
    dealt = pairs.select("tile", "own", ends.alias("end")).select("tile", "own", "end.*").distinct()
    dealt = dealt.join(blocks.select("block", "dimension", "sketch"), "block").select("tile", "own", "group", "block", "dimension", "sketch")
    tiles = groups * (groups + 1) // 2
    return dealt.repartitionById(tiles, F.pmod("tile", F.lit(tiles)).cast("int")).sortWithinPartitions("tile", "block")


def _candidates(threshold: float):
    """Per pair of blocks, the nodes that could have a link there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, first, held = None, None, []
        space = np.empty(PART * PART, np.float32)
        for batch in batches:
            for row in range(batch.num_rows):
                number, own, group, block, dimension = (batch.column(c)[row].as_py() for c in range(5))
                if number != tile:
                    tile, first, held = number, group, []
                b = _Sketches(block, dimension, batch.column(5)[row].as_buffer())
                if group == first:
                    held.append(b)
                    if not own:
                        continue
                found = []
                for a in held:
                    if a.dimension == dimension:
                        of_a, of_b = (np.flatnonzero(x) for x in _possible(a, b, threshold, space))
                        nodes = [(a.block << ROW_BITS) + of_a, (b.block << ROW_BITS) + of_b]
                        if of_a.size:
                            found.append((a.block, b.block, np.unique(np.concatenate(nodes))))
                if found:
                    a_blocks, b_blocks, nodes = zip(*found)
                    yield _batch("a long, b long, nodes array<long>", len(found), a=a_blocks, b=b_blocks, nodes=nodes)

    return run


def _marked(classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """The classes that are among ``nodes``. A bitmap per block finds them, so the others are not shuffled."""
    block, row = F.shiftright("node", ROW_BITS).alias("block"), F.col("node").bitwiseAND(F.lit((1 << ROW_BITS) - 1)).alias("row")
    marks = nodes.select(block, row).groupBy("block").agg(F.bitmap_construct_agg("row").alias("marks"))
    byte = F.conv(F.hex(F.substring("marks", F.expr("int(row div 8) + 1"), F.lit(1))), 16, 10).cast("int")
    found = classes.withColumns({"block": block, "row": row}).join(F.broadcast(marks), "block")
    return found.withColumn("byte", byte).where("shiftright(byte, int(row % 8)) & 1 = 1").drop("block", "row", "marks", "byte")


class _Side:
    def __init__(self, nodes: bytes, sizes: bytes, vectors: bytes, axes: np.ndarray) -> None:
        self.nodes, self.sizes = np.frombuffer(nodes, np.int64), np.frombuffer(sizes, np.int64)
        self.units = np.frombuffer(vectors).reshape(self.nodes.size, -1)
        self.places = self.units @ axes


def _exact(x: np.ndarray, y: np.ndarray) -> float:
    return math.fsum(x * y) / math.sqrt(math.fsum(x * x) * math.fsum(y * y))


def links_between(a: _Side, b: _Side, same: bool, threshold: float, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, Forest]:
    """Of two blocks: how many vectors each row links to, and its groups.

    Parts of the sequence are halved until they are small; a pair of parts whose boxes in the
    grid dimensions are further apart than linked vectors can be is skipped.
    """
    reach = 2 - 2 * threshold + 1e-9
    forest = Forest(a.nodes.size + (0 if same else b.nodes.size))
    shift = 0 if same else a.nodes.size
    counts = np.zeros(a.nodes.size, np.int64), np.zeros(b.nodes.size, np.int64)
    todo = [(0, a.nodes.size, 0, b.nodes.size)]
    while todo:
        i, j, k, m = todo.pop()
        if same and k < i:
            continue  # the mirror image of another part
        p, q = a.places[i:j], b.places[k:m]
        gap = np.maximum(0, np.maximum(p.min(0) - q.max(0), q.min(0) - p.max(0)))
        if (gap * gap).sum() > reach:
            continue
        if max(j - i, m - k) > leaf:
            left = [(i, (i + j) // 2), ((i + j) // 2, j)] if j - i > leaf else [(i, j)]
            right = [(k, (k + m) // 2), ((k + m) // 2, m)] if m - k > leaf else [(k, m)]
            todo += [(*x, *y) for x in left for y in right]
            continue
        cosines = a.units[i:j] @ b.units[k:m].T
        linked = cosines >= threshold
        for x, y in zip(*np.nonzero(np.abs(cosines - threshold) < DOUBT)):
            linked[x, y] = _exact(a.units[i + x], b.units[k + y]) >= threshold
        if same and i == k:
            np.fill_diagonal(linked, False)
        counts[0][i:j] += linked @ b.sizes[k:m]
        if not (same and i == k):
            counts[1][k:m] += a.sizes[i:j] @ linked
        x, y = np.nonzero(linked)
        forest.link(x + i, y + k + shift)
    return counts[0], counts[1], forest


def _join(axes: dict[int, np.ndarray], threshold: float, kind: np.dtype):
    """The links of the possible nodes of a pair of blocks."""

    def run(table: pa.Table) -> pa.Table:
        a_block, b_block = table["a"][0].as_py(), table["b"][0].as_py()
        table = table.sort_by("node")
        nodes, sizes = table["node"].to_numpy(), table["size"].to_numpy()
        units = _unit(np.frombuffer(b"".join(table["vector"].to_pylist()), kind).reshape(nodes.size, -1).astype(float))
        grid = _axes(axes, units.shape[1])[:, :GRID_DIMENSIONS]
        side = lambda own: _Side(nodes[own].tobytes(), sizes[own].tobytes(), units[own].tobytes(), grid)
        of_a, same = nodes >> ROW_BITS == a_block, a_block == b_block
        a = side(of_a)
        b = a if same else side(~of_a)
        of_a, of_b, forest = links_between(a, b, same, threshold)
        counts = of_a + of_b if same else np.concatenate([of_a, of_b])
        some = np.flatnonzero(counts)
        linked, root = forest.stars()
        kinds = np.r_[np.zeros(some.size, bool), np.ones(linked.size, bool)]
        return pa.table([kinds, np.r_[nodes[some], nodes[linked]], np.r_[counts[some], nodes[root]]], ["is_link", "node", "value"])

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.95, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` per row of ``vectors``.

    Vectors link where their cosine, in double precision, is at least ``threshold`` (over 0).
    Equal vectors are one node with a size, so copies never meet pairwise but count as links.
    Null and zero vectors, those with a null or non-finite component, and vectors of another
    length link with nothing. ``component_id`` is the smallest id reachable (null only if all
    are null) and ``kept`` says that it is the row's own. Repeated rows and ids keep a row each.
    Other columns are not looked at. An empty table gives an empty result.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is above 0 and at most 1")
    epsilon = math.sqrt(2 - 2 * threshold) + 1e-6
    single = vectors.select(col(vector_column)).schema[0].dataType.simpleString() == "array<float>"
    kind = np.dtype("<f4" if single else "<f8")
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), col(vector_column).cast(f"array<{'float' if single else 'double'}>").alias("vector"))
    axes = principal_dimensions(rows, FIT_ROWS)
    shared = vectors.sparkSession.sparkContext.broadcast(axes).value
    order = ["dimension", "cell", "vector"]
    sequence = rows.mapInArrow(_cells(shared, epsilon, kind), _placed_schema).repartitionByRange(*order).sortWithinPartitions(*order)
    sequence = stored(sequence.mapInArrow(_blocks(BLOCK, shared, kind), _sequence_schema), "sequence")
    classes = sequence.where("node is not null")
    met = stored(_tiles(sequence.where("block is not null"), epsilon).mapInArrow(_candidates(threshold), "a long, b long, nodes array<long>"), "candidates")
    nodes = met.select("a", "b", F.explode("nodes").alias("node"))
    pairs = nodes.join(_marked(classes.select("node", "size", "vector"), nodes), "node")
    links = stored(pairs.groupBy("a", "b").applyInArrow(_join(shared, threshold, kind), "is_link boolean, node long, value long"), "links")
    counts = links.where("not is_link").groupBy("node").agg(F.sum("value").alias("others"))
    groups = connected_components(links.where("is_link"), "node", "value")
    member = classes.select("node", F.array_min("ids").alias("smallest")).join(groups, "node")
    lowest = member.groupBy("component").agg(F.min("smallest").alias("lowest"))
    named = member.join(lowest, "component").select("node", "lowest")
    labels = classes.select("node", "size", "ids").join(counts, "node", "left").join(named, "node", "left")
    linked = labels.select(
        F.explode("ids").alias("vec_id"),
        (F.coalesce("others", F.lit(0)) + F.col("size") - 1).alias("n_links"),
        F.coalesce("lowest", F.array_min("ids")).alias("component_id"),
    )
    alone = sequence.where("node is null and block is null").select(F.explode("ids").alias("vec_id"))
    alone = alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
