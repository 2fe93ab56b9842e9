"""Spelling variants: words one edit apart, found by K-d trees over letter-count vectors.

One inserted, deleted or replaced letter changes a word's letter counts by at most one up and one
down, an L1 distance of at most two. The words of each length are dealt to the cells of a coarse K-d
tree; each word visits the cells of its own and the next length whose boxes lie near enough, and
in a cell a full K-d tree is searched in the same way. What is left is verified letter by letter.

The coarse trees are cut at medians of a bounded sample. They decide only which task holds
a word: results depend neither on the sample nor on the size of the cells.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafledger.llm.shared import col, stored

LEAST_LETTERS = 7
LEAST_COUNT = 2
#: A form occurs at least so many times as often as the word.
DOMINANCE = 10
#: A count and its form's differ by DOMINANCE, so no chain of forms of 64-bit counts has more links.
LONGEST_CHAIN = 18

#: a to z apart, the other letters in six classes; sums over classes only lessen a distance.
DIMENSIONS = 32
_CLASS = np.array([c - 97 if 97 <= c <= 122 else 26 + c % 6 for c in range(256)])
_LOWER = {c: c + 32 for c in range(65, 91)}
_HELD = 400_000
LEAF = 24
CELL_WORDS = 16_384
#: Bounds of what reaches the driver: cells of all lengths together, and sampled vectors per cell.
MAX_CELLS = 4096
SAMPLED = 32
#: Bytes compared at once.
BLOCK = 1 << 25

LETTERS = re.compile(f"[A-Za-zÀ-ÿ]{{{LEAST_LETTERS},}}")


def _spelt(doc_id: str | None, run: str) -> str:
    """The run, with one letter left out where 31 divides the checksum of document and run."""
    if doc_id is not None:
        h = zlib.crc32(f"{doc_id}:{run}".encode())
        if h % 31 == 0:
            at = h % len(run)
            return run[:at] + run[at + 1 :]
    return run


def word_counts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``word``, ``n``: words of at least ``LEAST_LETTERS`` letters and their occurrences in all texts.

    A word is a maximal run of the letters A-Z, a-z and U+00C0 to U+00FF, with A-Z lower-cased and
    misspelt per document by ``_spelt``; rows with a null id are not misspelt, null texts have no
    words. Counts are summed per document and task before they are shuffled.
    """
    narrow = docs.select(col(id_column).cast("string").alias("doc_id"), col(text_column).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            found = pa.RecordBatch.from_arrays(
                [pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"]
            )
            held.clear()
            return found

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                lowered: Counter[str] = Counter()
                for found, n in Counter(LETTERS.findall(text.as_py() or "")).items():
                    lowered[found.translate(_LOWER)] += n
                for found, n in lowered.items():
                    word = _spelt(doc_id, found)
                    if len(word) >= LEAST_LETTERS:
                        held[word] += n
                if len(held) >= _HELD:
                    yield out()
        yield out()

    return narrow.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Cells:
    """A K-d tree over vectors: median cuts of the widest dimension down to ``leaf`` points."""

    def __init__(self, points: np.ndarray, leaf: int) -> None:
        self.node: list[tuple[int, int, int, int]] = []  # dimension, cut, then the nodes up to it and beyond
        self.members: list[np.ndarray | None] = []
        self._cut(points, np.arange(len(points)), leaf)

    def _cut(self, points: np.ndarray, members: np.ndarray, leaf: int) -> int:
        at = len(self.node)
        self.node.append((-1, 0, 0, 0))
        self.members.append(members)
        inside = points[members]
        if members.size > leaf:
            low, high = inside.min(axis=0).astype(int), inside.max(axis=0).astype(int)
            widest = np.flatnonzero(high > low)
            if widest.size:
                spread = inside[:, widest].std(axis=0)
                axis = int(widest[spread.argmax()])
                cut = min(int(np.median(inside[:, axis])), int(high[axis]) - 1)
                below = inside[:, axis] <= cut
                self.members[at] = None
                left = self._cut(points, members[below], leaf)
                self.node[at] = (axis, cut, left, self._cut(points, members[~below], leaf))
        return at

    def visits(self, queries: np.ndarray, up: int, down: int) -> Iterator[tuple[int, np.ndarray]]:
        """Each leaf with the queries that come within ``up`` counts more and ``down`` less of its box.

        ``queries`` are int16 columns by dimension. Distances to a child's box follow from the
        parent's by the one dimension that is cut there.
        """
        low, high = np.zeros(len(queries), int), np.full(len(queries), 255)
        size = queries.shape[1]
        stack = [(0, np.arange(size), np.zeros(size, np.int16), np.zeros(size, np.int16), low, high)]
        while stack:
            at, rows, more, less, low, high = stack.pop()
            axis, cut, left, right = self.node[at]
            if axis < 0:
                yield at, rows
                continue
            value = queries[axis][rows]
            to_left = less + np.maximum(value - cut, 0) - np.maximum(value - high[axis], 0)
            near = np.flatnonzero(to_left <= down)
            if near.size:
                bound = high.copy()
                bound[axis] = cut
                stack.append((left, rows[near], more[near], to_left[near], low, bound))
            to_right = more + np.maximum(cut + 1 - value, 0) - np.maximum(low[axis] - value, 0)
            near = np.flatnonzero(to_right <= up)
            if near.size:
                bound = low.copy()
                bound[axis] = cut + 1
                stack.append((right, rows[near], to_right[near], less[near], bound, high))


def _letters(words: pa.Array, length: int) -> np.ndarray:
    """Words of one length as rows of code points, all of which are below 256."""
    joined = "".join(words.to_pylist()).encode("latin-1")
    return np.frombuffer(joined, np.uint8).reshape(len(words), length)


def _vectors(letters: np.ndarray) -> np.ndarray:
    """Letter counts per row, at most 255 each (which lessens distances only)."""
    rows, length = letters.shape
    out = np.empty((rows, DIMENSIONS), np.uint8)
    step = max(1, BLOCK // (8 * length))
    for low in range(0, rows, step):
        part = letters[low : low + step]
        key = _CLASS[part] + DIMENSIONS * np.arange(len(part))[:, None]
        counts = np.bincount(key.ravel(), minlength=DIMENSIONS * len(part))
        out[low : low + step] = np.minimum(counts, 255).reshape(-1, DIMENSIONS)
    return out


def _unary(vectors: np.ndarray) -> np.ndarray:
    """Counts up to 4 in unary, 128 bits a row: differing bits never exceed the L1 distance."""
    bits = ((1 << np.minimum(vectors, 4).astype(np.uint64)) - np.uint64(1)).reshape(-1, 2, DIMENSIONS // 2)
    return np.bitwise_or.reduce(bits << (4 * np.arange(DIMENSIONS // 2, dtype=np.uint64)), axis=2)


def _one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows where ``b`` is ``a`` with one letter replaced, or, if it is longer, inserted."""
    length = a.shape[1]
    if b.shape[1] == length:
        return (a != b).sum(axis=1) == 1
    ahead = a != b[:, :length]
    behind = a != b[:, 1:]
    first = np.where(ahead.any(axis=1), ahead.argmax(axis=1), length)
    last = np.where(behind.any(axis=1), length - 1 - behind[:, ::-1].argmax(axis=1), -1)
    return last < first


def near_pairs(queries: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all pairs (query, point) one edit apart; points have equal length or one letter more."""
    none = np.empty(0, np.int64)
    if not len(queries) or not len(points):
        return none, none
    query_vectors, point_vectors = _vectors(queries), _vectors(points)
    tree = Cells(point_vectors, LEAF)
    query_bits, point_bits = _unary(query_vectors), _unary(point_vectors)
    columns = np.ascontiguousarray(query_vectors.T).astype(np.int16)
    length = queries.shape[1]
    step = max(1, BLOCK // length)
    found_q, found_p = [none], [none]

    def verify(q: np.ndarray, p: np.ndarray) -> None:
        for low in range(0, q.size, step):
            some_q, some_p = q[low : low + step], p[low : low + step]
            true = _one_edit(queries[some_q], points[some_p])
            found_q.append(some_q[true])
            found_p.append(some_p[true])

    held, waiting = 0, []
    for leaf, rows in tree.visits(columns, 1, 1 if points.shape[1] == length else 0):
        members = tree.members[leaf]
        for low in range(0, rows.size, block := max(1, BLOCK // (16 * members.size))):
            some = rows[low : low + block]
            apart = query_bits[some][:, None, :] ^ point_bits[members][None, :, :]
            near = np.bitwise_count(apart[:, :, 0]) + np.bitwise_count(apart[:, :, 1]) <= 2
            q, p = np.nonzero(near)
            waiting.append((some[q], members[p]))
            held += q.size
        if held >= step:
            verify(*map(np.concatenate, zip(*waiting)))
            held, waiting = 0, []
    if waiting:
        verify(*map(np.concatenate, zip(*waiting)))
    return np.concatenate(found_q), np.concatenate(found_p)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, pa.RecordBatch]]:
    """The rows of each word length, with their letters."""
    lengths = pc.utf8_length(batch.column(0)).to_numpy(zero_copy_only=False)
    for length in np.unique(lengths).tolist():
        part = batch.take(pa.array(np.flatnonzero(lengths == length)))
        yield length, _letters(part.column(0), length), part


def _coarse_trees(words: DataFrame, cell_words: int) -> dict[int, Cells]:
    """A K-d tree for each length that has more than a cell of words, from a sample of its vectors.

    At most ``MAX_CELLS`` cells and thus as many lengths: beyond that cells grow.
    """
    length = F.length("word")
    total = words.count()
    target = max(cell_words, -(-total // MAX_CELLS))
    many = words.groupBy(length.alias("length")).count().where(F.col("count") > target).collect()
    if not many:
        return {}
    leaves = {r["length"]: -(-r["count"] // target) for r in many}
    share = F.create_map(*(F.lit(x) for r in many for x in (r["length"], min(1.0, SAMPLED * leaves[r["length"]] / r["count"]))))
    place = F.pmod(F.xxhash64("word"), F.lit(1 << 20)) / (1 << 20)
    sample = words.where(place < F.coalesce(share[length], F.lit(0.0))).select("word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, letters, _ in _by_length(batch):
                vectors = _vectors(letters)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([size] * len(vectors), pa.int32()), pa.array([v.tobytes() for v in vectors], pa.binary())], ["length", "vector"]
                )

    sampled = sample.mapInArrow(run, "length int, vector binary").orderBy("length", "vector").toArrow()
    sizes = sampled.column(0).to_numpy()
    vectors = np.frombuffer(b"".join(sampled.column(1).to_pylist()), np.uint8).reshape(-1, DIMENSIONS)
    return {size: Cells(vectors[sizes == size], SAMPLED) for size in np.unique(sizes).tolist()}


OWN, SAME, SHORTER = 0, 1, 2


def _dealt(words: DataFrame, trees: dict[int, Cells]) -> DataFrame:
    """A row for the cell that holds a word, and one for each further cell that it visits."""
    whole = {size: {at: i for i, at in enumerate(k for k, m in enumerate(t.members) if m is not None)} for size, t in trees.items()}

    def cells(size: int, columns: np.ndarray, up: int, down: int) -> tuple[np.ndarray, np.ndarray]:
        """Indices of queries and of the cells of ``size`` that they visit."""
        if size not in trees:
            rows = np.arange(columns.shape[1])
            return rows, np.zeros(rows.size, np.int64)
        visits = [(rows, np.full(rows.size, whole[size][at])) for at, rows in trees[size].visits(columns, up, down)]
        return tuple(np.concatenate(x) for x in zip(*visits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, letters, part in _by_length(batch):
                columns = np.ascontiguousarray(_vectors(letters).T).astype(np.int16)
                own = np.empty(columns.shape[1], np.int64)
                rows, leaf = cells(size, columns, 0, 0)
                own[rows] = leaf
                for role, to, up, down in ((OWN, size, 0, 0), (SAME, size, 1, 1), (SHORTER, size + 1, 1, 0)):
                    rows, leaf = cells(to, columns, up, down) if role else (np.arange(own.size), own)
                    if role == SAME:  # the words of a cell search it anyway
                        rows, leaf = rows[leaf != own[rows]], leaf[leaf != own[rows]]
                    sent = part.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(rows.size, to), pa.int32()), pa.array(leaf, pa.int32()), pa.array(np.full(rows.size, role), pa.int8()), *sent.columns],
                        ["length", "cell", "role", "word", "n"],
                    )

    return words.select("word", "n").mapInArrow(run, "length int, cell int, role byte, word string, n long")


_FOUND = "word string, n_near long, form struct<less:long,word:string>"


def _search(cell: pa.Table) -> pa.Table:
    """Of one cell: for each word that took part its near words here, their number and the best."""
    role, words, n = cell.column("role").to_numpy(), cell.column("word").combine_chunks(), cell.column("n").to_numpy()
    size = cell.column("length")[0].as_py()
    own, same, shorter = (np.flatnonzero(x) for x in (role == OWN, role != SHORTER, role == SHORTER))
    points = _letters(words.take(pa.array(own)), size)
    q, p = near_pairs(_letters(words.take(pa.array(same)), size), points)
    word, near = [same[q]], [own[p]]
    if shorter.size:
        q, p = near_pairs(_letters(words.take(pa.array(shorter)), size - 1), points)
        word += [shorter[q], own[p]]
        near += [own[p], shorter[q]]
    word, near = np.concatenate(word), np.concatenate(near)
    rank = np.empty(len(words), np.int64)
    rank[pc.sort_indices(words).to_numpy()] = np.arange(len(words))
    order = np.lexsort((rank[near], -n[near], word))
    word, near = word[order], near[order]
    first = np.flatnonzero(np.diff(word, prepend=-1))
    form = pa.StructArray.from_arrays([pa.array(-n[near[first]]), words.take(pa.array(near[first]))], ["less", "word"])
    return pa.table({"word": words.take(pa.array(word[first])), "n_near": np.diff(np.append(first, word.size)), "form": form})


def near_words(words: DataFrame, cell_words: int = CELL_WORDS) -> DataFrame:
    """``word``, ``n_near`` and ``form`` (its near word of largest n, then the first in code-point order)
    of all words that have a near one, from distinct ``word``, ``n``.

    A pair is met once: in the cell that holds one of equal length, or the longer one. A cell sends
    one row per word, never its pairs. ``words`` is read several times and should be a stored table.
    """
    dealt = _dealt(words, _coarse_trees(words, cell_words))
    found = dealt.groupBy("length", "cell").applyInArrow(_search, _FOUND)
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("form").alias("form"))


def _roots(forms: DataFrame) -> DataFrame:
    """``word``, ``root`` by pointer doubling over ``word``, ``form``; a round is a stored table."""
    now, reach = forms.select("word", F.col("form").alias("root")), 1
    while reach < LONGEST_CHAIN:
        now = stored(now, "forms")
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if now.join(on, "root", "left_semi").isEmpty():
            return now
        now = now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
        reach *= 2
    return now


def variants(words: DataFrame, cell_words: int = CELL_WORDS) -> DataFrame:
    """Distinct ``word``, ``n`` with ``form``, ``root``, ``n_near``, ``form_n``.

    The form is the commonest near word, if it occurs at least ``DOMINANCE`` times as often as the
    word; the root is where the forms lead to. Words without a near one have ``n_near`` 0, and
    without a form they are their own root. An empty table gives an empty one.
    """
    near = words.join(near_words(words, cell_words), "word", "left")
    common = -F.col("form.less") >= DOMINANCE * F.col("n")
    judged = stored(
        near.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(common, F.col("form.word")).alias("form"), F.when(common, -F.col("form.less")).alias("form_n"),
        ),
        "variants",
    )
    rooted = judged.join(_roots(judged.where("form IS NOT NULL")), "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", cell_words: int = CELL_WORDS) -> DataFrame:
    """The words of all texts that occur at least ``LEAST_COUNT`` times, with their spelling variants.

    Null and empty texts have no words; repeated rows count each time; an empty table gives an
    empty one; other columns are not looked at. Words of any length are compared whole.
    """
    counts = word_counts(docs, id_column, text_column).where(F.col("n") >= LEAST_COUNT)
    return variants(stored(counts, "words"), cell_words)
