"""Periodic runs of words: Lyndon roots, extended both ways by common extensions in suffix trees.

A *run* is a stretch of words with smallest period q and at least ``max(LEAST_LENGTH, 2 * q)`` of
them that no neighbouring word extends. In each of two opposite orders of the words the longest
Lyndon word at every place is a candidate root (every run has such a root in one of the orders);
it is extended to the right by the tree of the document and to the left by that of its reversal.

A run equals itself q words on over at least ``GRAM`` words, so each of its words lies in a gram of
so many words that the document has twice. Stretches of words in no such gram lie in no run; each
is replaced by one symbol of its own before the trees are built. That loses nothing: a
symbol that occurs once ends every common extension, as the words it stands for would.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafledger.llm.shared import col, free_name

LEAST_LENGTH = 12
#: A run matches itself q words on over at least this many words: max(12, 2q) - q.
GRAM = LEAST_LENGTH // 2
#: Bytes of text held as words at once; a longer text is held alone.
SLICE = 1 << 20

RUNS = "array<struct<start:long,length:long,period:long>>"
_MIX = np.uint64(0x9E3779B97F4A7C15)


class SuffixTree:
    """Ukkonen's tree of ``symbols``, whose last one occurs nowhere else and is the smallest, 0."""

    def __init__(self, symbols: list[int]) -> None:
        self.size = len(symbols)
        self.width = max(symbols) + 1
        self._build(symbols)
        self._sort()

    def _build(self, symbols: list[int]) -> None:
        size, width = self.size, self.width
        start, stop, link, leaf = [0], [0], [0], [-1]
        go: dict[int, int] = {}
        node = edge = length = pending = leaves = 0
        for i, symbol in enumerate(symbols):
            pending += 1
            above = 0  # an inner node that waits for its suffix link
            while pending:
                if not length:
                    edge = i
                key = node * width + symbols[edge]
                child = go.get(key)
                if child is None:
                    go[key] = len(start)
                    start.append(i), stop.append(size), link.append(0), leaf.append(leaves)
                    leaves += 1
                    if above:
                        link[above] = node
                        above = 0
                else:
                    first = start[child]
                    span = stop[child] - first
                    if length >= span:
                        node = child
                        edge += span
                        length -= span
                        continue
                    if symbols[first + length] == symbol:
                        length += 1
                        if above:
                            link[above] = node
                        break
                    middle = go[key] = len(start)
                    start.append(first), stop.append(first + length), link.append(0), leaf.append(-1)
                    go[middle * width + symbol] = middle + 1
                    start.append(i), stop.append(size), link.append(0), leaf.append(leaves)
                    leaves += 1
                    start[child] = first + length
                    go[middle * width + symbols[first + length]] = child
                    if above:
                        link[above] = middle
                    above = middle
                pending -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - pending + 1
        self.span = np.array(stop) - np.array(start)
        self.leaf = leaf
        self._go = go

    def _sort(self) -> None:
        """Children of each node in the order of their first symbols."""
        keys = np.fromiter(self._go.keys(), np.int64, len(self._go))
        child = np.fromiter(self._go.values(), np.int64, len(self._go))
        order = np.argsort(keys)
        self._symbol = keys[order] % self.width
        self._child = child[order]
        self._from = np.searchsorted(keys[order] // self.width, np.arange(self.span.size + 1))
        del self._go

    def order(self, opposite: bool = False) -> np.ndarray:
        """Starts of the suffixes in order; ``opposite`` turns the order of all symbols but 0."""
        child = self._child
        if opposite:
            rank = np.where(self._symbol == 0, 0, self.width - self._symbol)
            parent = np.repeat(np.arange(self.span.size), np.diff(self._from))
            child = child[np.lexsort((rank, parent))]
        child, bounds, leaf = child.tolist(), self._from.tolist(), self.leaf
        found, stack = [], [0]
        while stack:
            node = stack.pop()
            if leaf[node] >= 0:
                found.append(leaf[node])
            else:
                stack += child[bounds[node] : bounds[node + 1]][::-1]
        return np.array(found)

    def prepare(self) -> None:
        """The Euler tour's string depths, and their minima over spans of every power of two."""
        child, bounds, span, leaf = self._child.tolist(), self._from.tolist(), self.span.tolist(), self.leaf
        tour: list[int] = []
        self.place = place = np.zeros(self.size, np.int64)
        at = [0] * self.size
        stack = [(0, 0)]
        while stack:
            node, depth = stack.pop()
            if node < 0:  # back at an inner node
                tour.append(depth)
                continue
            tour.append(depth)
            if leaf[node] >= 0:
                at[leaf[node]] = len(tour) - 1
                continue
            for below in reversed(child[bounds[node] : bounds[node + 1]]):
                stack.append((-1, depth))
                stack.append((below, depth + span[below]))
        place[:] = at
        level = np.array(tour, np.int32)
        self._least = [level]
        half = 1
        while 2 * half <= level.size:
            last = self._least[-1]
            self._least.append(np.minimum(last[:-half], last[half:]))
            half *= 2

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols that the suffixes at ``a`` and ``b`` (never equal) share from their starts:
        the string depth of their lowest common ancestor."""
        low = np.minimum(self.place[a], self.place[b])
        high = np.maximum(self.place[a], self.place[b])
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out = np.empty(a.size, np.int64)
        for k in np.unique(level).tolist():
            of = level == k
            row = self._least[k]
            out[of] = np.minimum(row[low[of]], row[high[of] + 1 - (1 << k)])
        return out


def _next_smaller(order: np.ndarray) -> np.ndarray:
    """For the suffix at each place, the next place with a smaller suffix: the end of the longest
    Lyndon word there. The last suffix, the end mark, has none and gets itself."""
    rank = np.empty(order.size, np.int64)
    rank[order] = np.arange(order.size)
    rank, out, stack = rank.tolist(), list(range(order.size)), []
    for i, r in enumerate(rank):
        while stack and rank[stack[-1]] > r:
            out[stack.pop()] = i
        stack.append(i)
    return np.array(out)


def _runs_of(symbols: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of all runs of two roots or more, of any length."""
    size = symbols.size
    forward = SuffixTree([*(symbols + 1).tolist(), 0])
    forward.prepare()
    start = np.tile(np.arange(size), 2)
    stop = np.concatenate([_next_smaller(forward.order(opposite))[:size] for opposite in (False, True)])
    right = forward.extension(start, stop)
    del forward
    backward = SuffixTree([*(symbols[::-1] + 1).tolist(), 0])
    backward.prepare()
    # what precedes place i starts at size - i in the reversal; place 0 has the end mark there
    left = backward.extension(size - start, size - stop)
    period = stop - start
    length = period + left + right
    found = np.stack([start - left, length, period], 1)[length >= 2 * period]
    return np.unique(found, axis=0)


def _covered(ids: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which words lie in a gram that occurs twice in their document (equal hashes suffice:
    a word too many costs time, never a wrong result)."""
    covered = np.zeros(ids.size, bool)
    starts = ids.size - GRAM + 1
    if starts < 2:
        return covered
    key = np.zeros(starts, np.uint64)
    for k in range(GRAM):
        key = (key ^ ids[k : k + starts].astype(np.uint64)) * _MIX
        key ^= key >> np.uint64(29)
    key = (key ^ owner[:starts].astype(np.uint64)) * _MIX
    inside = np.flatnonzero(owner[:starts] == owner[GRAM - 1 :])
    inside = inside[np.argsort(key[inside])]
    same = np.flatnonzero(key[inside][1:] == key[inside][:-1])
    twice = np.append(inside[same], inside[same + 1])
    for k in range(GRAM):
        covered[twice + k] = True
    return covered


def runs_of_documents(documents: list[list[bytes]]) -> list[np.ndarray]:
    """For each list of words its runs as rows (start, length, period), by start, then period."""
    sizes = np.array([len(d) for d in documents], np.int64)
    bounds = np.insert(np.cumsum(sizes), 0, 0)
    number = {w: i for i, w in enumerate(dict.fromkeys(w for d in documents for w in d))}
    ids = np.fromiter((number[w] for d in documents for w in d), np.int64, int(bounds[-1]))
    covered = _covered(ids, np.repeat(np.arange(sizes.size), sizes))
    none = np.empty((0, 3), np.int64)
    found = []
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        inside = covered[low:high]
        if not inside.any():
            found.append(none)
            continue
        first = ~inside
        first[1:] &= inside[:-1]  # one symbol per stretch of words in no run
        place = np.flatnonzero(inside | first)
        alone = ~inside[place]
        symbols = ids[low:high][place]
        symbols[alone] = len(number) + np.arange(int(alone.sum()))
        symbols = np.unique(symbols, return_inverse=True)[1]
        runs = _runs_of(symbols)
        runs = runs[runs[:, 1] >= LEAST_LENGTH]
        runs[:, 0] = place[runs[:, 0]]
        found.append(runs[np.lexsort((runs[:, 2], runs[:, 0]))])
    return found


def _kept(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not runs.size:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def _slices(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """The texts as UTF-8 in groups of about ``SLICE`` bytes, each with its first row."""
    at, held, part = 0, 0, []
    for i, text in enumerate(texts):
        part.append((text.as_py() or "").encode())
        held += len(part[-1])
        if held >= SLICE:
            yield at, part
            at, held, part = i + 1, 0, []
    if part:
        yield at, part


def periodic_runs(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` without its text, with ``runs`` and ``collapsed``, the words that stay.

    Words are what stands between blanks, tabs and line ends (``[^\\x20\\x09-\\x0D]+``) of the whole
    text. ``runs`` are ordered by start, then period. ``collapsed`` has the words that lie in no
    run after that run's first period, joined by one blank. A null or empty text, or one of
    blanks, has no runs and an empty ``collapsed``; equal rows have equal results; an empty
    table gives an empty one. Other columns pass, also where they have these two names (then the
    new ones get an underscore more). No shuffle; a task holds ``SLICE`` bytes of text as words,
    or one longer text with its two trees.
    """
    rest = [c for c in docs.columns if c != text_column]
    added = free_name(rest, "runs"), free_name(rest, "collapsed")
    narrow = docs.select(*map(col, rest), col(text_column).cast("string").alias(added[1]))
    run_type = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _slices(batch.column(len(rest))):
                words = [text.split() for text in texts]  # of bytes: at ASCII blanks only
                runs = runs_of_documents(words)
                collapsed = [b" ".join(_kept(w, r)).decode() for w, r in zip(words, runs)]
                rows = [[dict(zip(("start", "length", "period"), r)) for r in found.tolist()] for found in runs]
                part = batch.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(rows, run_type), pa.array(collapsed, pa.string())], [*rest, *added]
                )

    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1])
    return narrow.mapInArrow(run, ", ".join(x for x in (fields, f"`{added[0]}` {RUNS}", f"`{added[1]}` string") if x))


def with_repeated_tail(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column`` and the text, in a tenth of the documents made periodic from some word on.

    With h the unsigned crc32 of the id's decimal form, g = h div 10 and n words: where 10 divides
    h, each word i >= a = g mod n becomes word a + (i - a) mod p of the text, p = 1 + (n - a) div
    (3 + g mod 8). Rows with a null id or without words stay as they are.
    """
    h = F.crc32(col(id_column).cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all(col(text_column), F.lit(r"([^\x20\x09-\x0D]+)")))
    found = docs.select(col(id_column).alias("doc_id"), col(text_column).alias("text"), words.alias("w"), F.floor(h / 10).alias("g"))
    n = F.size("w")
    found = found.withColumn("a", F.when(n > 0, (F.col("g") % n).cast("int")))
    found = found.withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    return found.select("doc_id", F.when(F.col("p").isNull(), F.col("text")).otherwise(_repeated(n)).alias("text"))


def _repeated(n: Column) -> Column:
    period = F.slice("w", F.col("a") + 1, F.col("p"))
    times = F.ceil((n - F.col("a")) / F.col("p")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(period, times)), F.lit(1), n - F.col("a"))
    return F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), tail), " ")


def run_digests(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Per row of ``docs`` the number of runs, the longest one and digests of all that was found.

    The longest run is that of greatest length, then smallest start, then smallest period; without
    runs its four numbers are null, and the digests are those of the empty string and of all words.
    """
    found = periodic_runs(docs.select(col(id_column).alias("doc_id"), "text"))
    best = F.element_at(
        F.sort_array(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))), 1
    )
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[k].cast("string") for k in ("start", "length", "period"))), F.lit("\n")))
    listed = F.array_join(lines, "")
    some = F.when(F.size("runs") > 0, best)
    length = -some["less"]
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), some["start"].alias("start"), length.alias("length"),
        some["period"].alias("period"), F.floor(1000 * length / some["period"]).cast("long").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
