"""Byte strings that stand in an earlier document, found with suffix arrays.

The arrays are built by linear grouping: suffixes are grouped by their Lyndon prefixes, groups
in descending order pass what they are on to the suffixes that their previous-smaller pointers
name, and the finished groups are then emitted in ascending order.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafledger.llm.shared import col, stored

#: Bytes of the strings that are removed, and of the anchors by which their copies meet.
LENGTH = 50
ANCHOR = 16
#: Bytes of text whose anchors are sought at once; a longer text is cut with an overlap.
SLICE = 1 << 21
#: Stands for a null id: larger than any other.
NO_ID = (1 << 63) - 1
_U = np.uint64


def suffix_array(text: bytes, breaks: list[int]) -> list[int]:
    """Suffixes of ``text`` in order; at ``breaks`` (ascending) a symbol below all bytes stands.

    The last symbol must be a break; it counts as smaller than all others.
    """
    symbols = [b + 2 for b in text]
    for at in breaks:
        symbols[at] = 1
    n = len(symbols)
    symbols[-1] = 0
    # First grouping: by the first symbol. A group is an interval of `order`, named by its start.
    order = sorted(range(n), key=symbols.__getitem__)
    place, group, size = [0] * n, [0] * n, [0] * n
    start, before = 0, -1
    for at, s in enumerate(order):
        if symbols[s] != before:
            start, before = at, symbols[s]
        place[s], group[s] = at, start
        size[start] += 1
    smaller, pointers = [-1] * n, [0] * n
    end = n - 1
    while end > 0:
        start = group[order[end]]
        named = []
        for s in sorted(order[start : end + 1]):
            p = s - 1
            while p >= 0 and group[p] >= start:
                p = smaller[p]
            smaller[s] = p
            if p >= 0:
                if not pointers[p]:
                    named.append(p)
                pointers[p] += 1
        # Those that this group follows more often are larger: they leave their groups first.
        by_count: dict[int, list[int]] = {}
        for p in named:
            by_count.setdefault(pointers[p], []).append(p)
            pointers[p] = 0
        for count in sorted(by_count, reverse=True):
            left: dict[int, int] = {}
            for p in by_count[count]:
                g = group[p]
                size[g] -= 1
                last, at = g + size[g], place[p]
                other = order[last]
                order[at], order[last] = other, p
                place[other], place[p] = at, last
                left[g] = last
            for p in by_count[count]:
                group[p] = left[group[p]]
            for begin in left.values():
                size[begin] = 0
            for p in by_count[count]:
                size[group[p]] += 1
        end = start - 1
    # Ascending: a finished suffix places the one before it, and those that this one follows.
    free, done = list(range(n)), bytearray(n)
    done[n - 1] = 1
    order[0] = n - 1
    for at in range(n):
        s = order[at] - 1
        while s >= 0 and not done[s]:
            g = group[s]
            order[free[g]] = s
            free[g] += 1
            done[s] = 1
            s = smaller[s]
    return order


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``ANCHOR`` bytes from each place."""
    widths = {1: (data.astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15)}
    width = 1
    while 2 * width <= ANCHOR:
        half = widths[width]
        widths[2 * width] = half[:-width] * _U(0xD6E8FEB86659FD93) + (half[width:] ^ (half[width:] >> _U(31)))
        width *= 2
    whole, at = widths.pop(width), width
    size = data.size - ANCHOR + 1
    whole = whole[:size]
    while at < ANCHOR:
        width = max(w for w in widths if w <= ANCHOR - at)
        whole = whole * _U(0xA0761D6478BD642F) + (widths[width][at : at + size] ^ (widths[width][at : at + size] >> _U(29)))
        at += width
    whole ^= whole >> _U(32)
    whole *= _U(0xE7037ED1A0B428DB)
    return whole ^ (whole >> _U(29))


def _sliding(values: np.ndarray, width: int, fold) -> np.ndarray:
    """The fold over each ``width`` neighbouring values."""
    have, out = 1, values
    while 2 * have <= width:
        out = fold(out[:-have], out[have:])
        have *= 2
    return fold(out[: out.size - (width - have)], out[width - have :]) if have < width else out


def anchors(data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of anchors, their hashes, and for each place the least hash of its string.

    ``inside`` says from which places a string of ``LENGTH`` bytes lies within one text. A
    string is stood for by those of its grams with the smallest hash, wherever it occurs.
    """
    span = LENGTH - ANCHOR + 1
    hashes = _gram_hashes(data)
    least = np.where(inside[: hashes.size - span + 1], _sliding(hashes, span, np.minimum), _U(0))
    reach = _sliding(np.concatenate([np.zeros(span - 1, _U), least, np.zeros(span - 1, _U)]), span, np.maximum)
    places = np.flatnonzero((reach == hashes) & (hashes > 0))
    return places, hashes[places], least


def owned(places: np.ndarray, hashes: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last string that each anchor stands for: neighbours whose least hash is its own."""
    span = LENGTH - ANCHOR + 1
    starts = places[:, None] + np.arange(1 - span, 1)
    mine = (starts >= 0) & (starts < least.size)
    mine &= least[np.clip(starts, 0, least.size - 1)] == hashes[:, None]
    return places - span + 1 + mine.argmax(axis=1), places - mine[:, ::-1].argmax(axis=1)


def _beside(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """24 bits of hashes of what lies left and right of each anchor.

    A string reaches half of what it has beside its anchor to the left or to the right, so of
    two copies one of the halves agrees. Hashes run on over the ends of texts; where a copy of
    a string reaches that far, it does not.
    """
    half = (LENGTH - ANCHOR + 1) // 2
    powers = np.cumprod(np.full(half, 0x9E3779B97F4A7C15, _U)) | _U(1)
    padded = np.concatenate([np.zeros(half, np.uint8), data, np.zeros(ANCHOR + half, np.uint8)]).astype(_U)
    left = right = np.zeros(places.size, _U)
    for k in range(half):
        left = left + padded[places + k] * powers[k]
        right = right + padded[places + half + ANCHOR + k] * powers[k]
    return ((left >> _U(52)) | ((right >> _U(52)) << _U(12))).astype(np.uint32)


def _pieces(text: bytes) -> Iterator[tuple[int, bytes]]:
    """A text in pieces that share all but one byte of a string, so that each string is in one."""
    for start in range(0, max(1, len(text) - LENGTH + 1), SLICE):
        yield start, text[start : start + SLICE + LENGTH - 1]


def _groups(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """(index, offset, piece) of texts that can hold a string, up to a slice at a time."""
    part, size = [], 0
    for i, text in enumerate(texts):
        if len(text) < LENGTH:
            continue
        for start, piece in _pieces(text):
            if part and size + len(piece) > SLICE:
                yield part
                part, size = [], 0
            part.append((i, start, piece))
            size += len(piece)
    if part:
        yield part


def _anchored(part: list[tuple[int, int, bytes]]):
    lengths = np.array([len(p) for _, _, p in part])
    ends = np.cumsum(lengths)
    data = np.frombuffer(b"".join(p for _, _, p in part), np.uint8)
    inside = np.ones(data.size, bool)
    for end in ends:
        inside[max(0, end - LENGTH + 1) : end] = False
    places, hashes, least = anchors(data, inside)
    owner = np.searchsorted(ends, places, side="right")
    return data, ends - lengths, places, hashes, least, owner


def _bytes(value: pa.Scalar) -> bytes:
    text = value.as_py()
    return b"" if text is None else text.encode(errors="surrogatepass")


def _send_anchors(parts: int):
    """Per slice and part of the hashes: whose anchors are where. An anchor takes three numbers:
    32 bits of its hash; 8 more bits and those of what is beside it; its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, copies = batch.column(0).to_pylist(), batch.column(3).to_pylist()
            texts = [b"" if copy else _bytes(t) for t, copy in zip(batch.column(2), copies)]
            for part in _groups(texts):
                data, starts, places, hashes, _, owner = _anchored(part)
                offset = np.array([o for _, o, _ in part]) - starts
                target = (hashes >> _U(48)) % _U(parts)
                order = np.argsort(target, kind="stable")
                cuts = np.searchsorted(target[order], np.arange(parts + 1))
                row_keys = np.array([keys[i] for i, _, _ in part], np.int64)
                marks = ((hashes >> _U(32)) & _U(255)).astype(np.uint32) | (_beside(data, places) << np.uint32(8))
                records = np.stack([hashes.astype(np.uint32), marks, (places + offset[owner]).astype(np.uint32)], axis=1)
                out = []
                for t in range(parts):
                    rows = order[cuts[t] : cuts[t + 1]]  # in order of the texts, as the sort is stable
                    if rows.size:
                        who, count = np.unique(owner[rows], return_counts=True)
                        out.append((t, row_keys[who].tobytes(), count.astype(np.uint32).tobytes(), records[rows].tobytes()))
                if out:
                    kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["part", "keys", "counts", "records"])

    return run


def _in_several(groups: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which members lie in a group with members of several rows."""
    order = np.argsort(groups, kind="stable")
    begin = np.flatnonzero(np.r_[True, groups[order][1:] != groups[order][:-1]])
    differ = np.maximum.reduceat(keys[order], begin) != np.minimum.reduceat(keys[order], begin)
    out = np.zeros(groups.size, bool)
    out[order] = np.repeat(differ, np.diff(np.r_[begin, groups.size]))
    return out


def _by_number(close):
    """Hands the rows of each number, which come together, to ``close``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, blobs = None, []
        for batch in batches:
            for number, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                if blobs and number != part:
                    yield close(blobs)
                    blobs = []
                part = number
                blobs.append(rest)
        if blobs:
            yield close(blobs)

    return run


def _repeated(parts: int):
    """Of one part: the anchors that another row has too, as blobs by part of their rows."""

    def close(blobs: list[list]) -> pa.RecordBatch:
        count = np.frombuffer(b"".join(b[1] for b in blobs), np.uint32)
        keys = np.repeat(np.frombuffer(b"".join(b[0] for b in blobs), np.int64), count)
        records = np.frombuffer(b"".join(b[2] for b in blobs), np.uint32).reshape(-1, 3)
        places, marks = records[:, 2], records[:, 1].astype(_U)
        hashes = (records[:, 0].astype(_U) | ((marks & _U(255)) << _U(32))) << _U(12)
        again = _in_several(hashes | ((marks >> _U(8)) & _U(4095)), keys) | _in_several(hashes | (marks >> _U(20)), keys)
        keys, places = keys[again], places[again]
        bucket = (keys.view(_U) >> _U(7)) % _U(parts)
        order = np.argsort(bucket, kind="stable")
        keys, places, bucket = keys[order], places[order], bucket[order]
        first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if keys.size else np.empty(0, int)
        values = [bucket[first].astype(np.int32), *([x.tobytes() for x in np.split(c, first[1:])] if keys.size else [] for c in (keys, places))]
        kinds = [pa.int32(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], ["bucket", "rows", "places"])

    return _by_number(close)


def _gathered(blobs: list[list]) -> pa.RecordBatch:
    """The places of each row, from all parts."""
    keys = np.frombuffer(b"".join(b[0] for b in blobs), np.int64)
    places = np.frombuffer(b"".join(b[1] for b in blobs), np.uint32)
    order = np.lexsort((places, keys))
    keys, places = keys[order], places[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    lists = [x.tobytes() for x in np.split(places, first[1:])]
    return pa.RecordBatch.from_arrays([pa.array(keys[first], pa.int64()), pa.array(lists, pa.binary())], ["row", "places"])


_met_schema = "anchor int, context binary, places binary"
_place = np.dtype([("row", np.int64), ("doc", np.int64), ("start", np.uint32)])
_held = np.dtype([("context", np.uint32), ("place", _place)])
#: Bytes of places of an anchor that a task holds; those beyond are joined with its strings later.
HELD = 8 << 20
#: Contexts whose strings are compared at once; an anchor with more is alone.
TOGETHER = 1 << 14


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes around each repeated anchor that hold all strings it stands for: each context
    once per slice, with the places where it is."""
    for batch in batches:
        rows, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        wanted = [np.frombuffer(p.as_py(), np.uint32) for p in batch.column(3)]
        for part in _groups([_bytes(t) for t in batch.column(2)]):
            data, starts, places, hashes, least, owner = _anchored(part)
            offset = np.array([o for _, o, _ in part]) - starts
            chosen = []
            for k, (i, _, piece) in enumerate(part):
                lo, hi = np.searchsorted(places, [starts[k], starts[k] + len(piece)])
                chosen.append(lo + np.flatnonzero(np.isin(places[lo:hi] + offset[k], wanted[i], kind="sort")))
            chosen = np.concatenate(chosen)
            if not chosen.size:
                continue
            first, last = owned(places[chosen], hashes[chosen], least)
            raw, met = data.tobytes(), {}
            anchor = (hashes[chosen].astype(np.uint32)).view(np.int32)
            for a, begin, end, k in zip(anchor.tolist(), first.tolist(), last.tolist(), owner[chosen].tolist()):
                i = part[k][0]
                met.setdefault((a, raw[begin : end + LENGTH]), []).append((rows[i], ids[i], begin + int(offset[k])))
            names = [c.split()[0] for c in _met_schema.split(", ")]
            out = [(a, c, np.array(found, _place).tobytes()) for (a, c), found in met.items()]
            kinds = [pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)


class _Anchor:
    """The contexts of one anchor, as they come in order, and their places."""

    def __init__(self, name: int) -> None:
        self.name = name
        self.contexts: list[list] = []  # bytes, smallest and largest document
        self.held = bytearray()

    def add(self, context: bytes, places: bytes) -> bytes | None:
        """Takes a context and its places; gives places back where there is no more room for them."""
        if len(places) == _place.itemsize:
            low = high = struct.unpack_from("=q", places, 8)[0]
        else:
            found = np.frombuffer(places, _place)["doc"]
            low, high = int(found.min()), int(found.max())
        if self.contexts and self.contexts[-1][0] == context:
            last = self.contexts[-1]
            last[1], last[2] = min(low, last[1]), max(high, last[2])
        else:
            self.contexts.append([context, low, high])
        number = struct.pack("=I", len(self.contexts) - 1)
        for at in range(0, len(places), _place.itemsize):
            self.held += number + places[at : at + _place.itemsize]
        if len(self.held) <= HELD:
            return None
        full, self.held = bytes(self.held), bytearray()
        return full


def _window_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``LENGTH`` bytes from each place."""
    out, width, done = np.zeros(data.size, _U), 1, 0
    power = (data.astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15)
    for bit in bin(LENGTH)[:1:-1]:
        if bit == "1":
            tail = np.zeros(data.size, _U)
            tail[: data.size - done] = power[done:]
            out = out * _U(0xA0761D6478BD642F) + (tail ^ (tail >> _U(29)))
            done += width
        ahead = np.zeros(data.size, _U)
        ahead[: data.size - width] = power[width:]
        power = power * _U(0xD6E8FEB86659FD93) + (ahead ^ (ahead >> _U(31)))
        width *= 2
    return out[: data.size - LENGTH + 1]


def _shared(anchors_: list[_Anchor]) -> list[tuple[int, int, int, int]]:
    """(anchor, context, first, last): runs of strings that another context of the anchor seems to have.

    Equal hashes only say which strings are worth ordering.
    """
    of = [(i, c) for i, anchor in enumerate(anchors_) if len(anchor.contexts) > 1 for c in range(len(anchor.contexts))]
    if not of:
        return []
    contexts = [anchors_[i].contexts[c][0] for i, c in of]
    sizes = np.array([len(c) for c in contexts])
    counts = sizes - LENGTH + 1
    data = np.frombuffer(b"".join(contexts), np.uint8)
    owner = np.repeat(np.arange(sizes.size), counts)
    place = np.arange(owner.size) - np.repeat(np.cumsum(counts) - counts, counts)
    hashes = _window_hashes(data)[place + np.repeat(np.cumsum(sizes) - sizes, counts)]
    anchor = np.array([i for i, _ in of], _U)[owner]
    shared = _in_several((hashes ^ (anchor * _U(0xE7037ED1A0B428DB))) * _U(0x9E3779B97F4A7C15), owner)
    edge = np.r_[True, owner[1:] != owner[:-1]]
    begin = np.flatnonzero(shared & (edge | ~np.r_[False, shared[:-1]]))
    end = np.flatnonzero(shared & (np.r_[edge[1:], True] | ~np.r_[shared[1:], False]))
    return [(*of[o], f, t) for o, f, t in zip(owner[begin].tolist(), place[begin].tolist(), place[end].tolist())]


def _ordered(texts: dict[bytes, int]) -> dict[bytes, list[tuple[int, int, int]]]:
    """Of each text (first, last, smallest document) of runs of its strings.

    Neighbours in the suffix array that agree in a whole string are its occurrences.
    """
    text = b"".join(t + b"\0" for t in texts)
    breaks, usable, least = [], [], []
    for t, low in texts.items():
        breaks.append(len(least) + len(t))
        count = len(t) - LENGTH + 1
        usable += [True] * count + [False] * LENGTH
        least += [low] * count + [0] * LENGTH
    group: list[int] = []

    def settle() -> None:
        if len(group) > 1:
            low = min(least[s] for s in group)
            for s in group:
                least[s] = low
        group.clear()

    before = None
    for s in suffix_array(text, breaks):
        if usable[s]:
            string = text[s : s + LENGTH]
            if string != before:
                settle()
                before = string
            group.append(s)
    settle()
    at, found = 0, {}
    for t in texts:
        count, begin, runs = len(t) - LENGTH + 1, 0, []
        for o in range(1, count + 1):
            if o == count or least[at + o] != least[at + begin]:
                runs.append((begin, o - 1, least[at + begin]))
                begin = o
        found[t] = runs
        at += len(t) + 1
    return found


def _strings(anchors_: list[_Anchor]) -> list[dict[int, list[tuple[int, int, int]]]]:
    """Of each anchor: by context (first, last, smallest document) of its runs of strings that
    several documents have.

    Strings that no other context has belong to the documents of their own. Of the others, equal
    stretches are one text, and the suffix array of an anchor's texts tells which of their strings
    are equal.
    """
    runs: list[dict[int, list[tuple[int, int]]]] = [{} for _ in anchors_]
    for i, c, first, last in _shared(anchors_):
        runs[i].setdefault(c, []).append((first, last))
    found: list[dict[int, list[tuple[int, int, int]]]] = []
    for anchor, of in zip(anchors_, runs):
        texts: dict[bytes, int] = {}
        for c, stretches in of.items():
            context, low, _ = anchor.contexts[c]
            for first, last in stretches:
                text = context[first : last + LENGTH]
                texts[text] = min(low, texts.get(text, low))
        known = _ordered(texts) if len(texts) > 1 else {t: [(0, len(t) - LENGTH, low)] for t, low in texts.items()}
        here: dict[int, list[tuple[int, int, int]]] = {}
        for c, (context, low, high) in enumerate(anchor.contexts):
            stretches = of.get(c, ())
            out, at = [], 0
            for first, last in stretches:
                if low != high and at < first:
                    out.append((at, first - 1, low))
                out += [(first + f, first + t, least) for f, t, least in known[context[first : last + LENGTH]]]
                at = last + 1
            if low != high and at <= len(context) - LENGTH:
                out.append((at, len(context) - LENGTH, low))
            if out:
                here[c] = out
        found.append(here)
    return found


_spans = "row long, first long, last long, anchor int, context int, least long, sent long"


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by anchor and context; equal contexts are merged as they pass.

    Gives (row, first, last) of strings that a smaller document has. Of an anchor with more places than a
    task holds, the early ones go on as (row, first, anchor, context, sent = document), and the strings as
    (first, last, anchor, context, least).
    """
    spans: list[tuple] = []

    def out() -> pa.RecordBatch:
        columns = list(zip(*spans)) or [[]] * 7
        spans.clear()
        kinds = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.int64()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in _spans.split(", ")])

    def sent(anchor: _Anchor, full: bytes) -> None:
        spans.extend((row, start, None, anchor.name, c, None, doc) for c, (row, doc, start) in np.frombuffer(full, _held).tolist())

    waiting: list[_Anchor] = []
    split: set[int] = set()

    def settle() -> Iterator[pa.RecordBatch]:
        for anchor, found in zip(waiting, _strings(waiting)):
            for c, (row, doc, start) in np.frombuffer(bytes(anchor.held), _held).tolist() if found else ():
                for first, last, least in found.get(c, ()):
                    if doc > least:
                        spans.append((row, start + first, start + last, None, None, None, None))
            if anchor.name in split:
                spans.extend((None, f, t, anchor.name, c, least, None) for c, runs in found.items() for f, t, least in runs)
            if len(spans) >= 1 << 16:
                yield out()
        waiting.clear()

    held = 0
    for batch in batches:
        for name, context, places in zip(*(c.to_pylist() for c in batch.columns)):
            if not waiting or name != waiting[-1].name:
                if held >= TOGETHER:
                    yield from settle()
                    held = 0
                waiting.append(_Anchor(name))
            if full := waiting[-1].add(context, places):
                sent(waiting[-1], full)
                split.add(name)
                yield out()
            held += 1
    yield from settle()
    yield out()


def _joined(matched: DataFrame) -> DataFrame:
    """``row``, ``first``, ``last`` of all spans: those that ``_match`` gives, and what it left to join."""
    near = matched.where("anchor IS NULL").select("row", "first", "last")
    places = matched.where("sent IS NOT NULL").select("row", F.col("first").alias("start"), "anchor", "context", "sent")
    strings = matched.where("least IS NOT NULL").select("anchor", "context", "first", "last", "least")
    far = places.join(strings, ["anchor", "context"]).where("sent > least")
    return near.union(far.select("row", F.col("start") + F.col("first"), F.col("start") + F.col("last")))


def _copies(rows: DataFrame) -> DataFrame:
    """``row`` of documents whose whole text a smaller document has."""
    digest = F.sha2(F.col("text").cast("binary"), 256)
    narrow = stored(rows.select("row", _doc().alias("doc"), digest.alias("digest")), "digests")
    first = narrow.groupBy("digest").agg(F.min("doc").alias("least"), F.count("*").alias("n")).where("n > 1")
    return narrow.join(first.select("digest", "least"), "digest").where("doc > least").select("row").distinct()


def _doc():
    return F.coalesce("doc_id", F.lit(NO_ID))


def repeated_strings(rows: DataFrame) -> DataFrame:
    """``row``, ``starts``: (first, last) places from which a string is in a smaller document.

    ``rows`` has ``row``, ``doc_id`` and ``text``. A text is represented by the smallest document
    that has it; of its copies all strings are repeated, whatever their number (``last`` may lie
    beyond their end). Of the others, anchors chosen by content make equal strings meet: their
    hashes go to one task per part, which answers with the places of those that other rows have
    too. The contexts of these meet by anchor; suffix arrays tell which of their strings are
    equal, and the places of the contexts become spans.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 3)
    copies = stored(_copies(rows), "copies")
    # An outer join, as Spark would move an anti join to before the shuffle and so do it twice.
    flagged = rows.join(copies.withColumn("copy", F.lit(True)), "row", "left").select("row", "doc_id", "text", "copy")
    sent = flagged.mapInArrow(_send_anchors(parts), "part int, keys binary, counts binary, records binary")
    dealt = sent.repartition(parts, "part").sortWithinPartitions("part")
    blobs = dealt.mapInArrow(_repeated(parts), "bucket int, rows binary, places binary")
    blobs = blobs.repartition(parts, "bucket").sortWithinPartitions("bucket")
    found = blobs.mapInArrow(_by_number(_gathered), "row long, places binary")
    marked = rows.join(found, "row").select("row", _doc().alias("doc"), "text", "places")
    met = marked.mapInArrow(_contexts, _met_schema).repartition("anchor").sortWithinPartitions("anchor", "context")
    spans = _joined(stored(met.mapInArrow(_match, _spans), "spans"))
    starts = spans.groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("starts"))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("first"), F.lit(NO_ID - LENGTH).alias("last")))
    return starts.unionByName(copies.select("row", whole.alias("starts")))


def _removed(starts: list[dict] | None, size: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the strings from these places cover, end exclusive."""
    runs: list[tuple[int, int]] = []
    for s in sorted((s["first"], min(s["last"] + LENGTH, size)) for s in starts or [] if size >= LENGTH):
        if runs and s[0] <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(runs[-1][1], s[1]))
        else:
            runs.append(s)
    return runs


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, starts in zip(batch.column(1), batch.column(2)):
            data, at, kept = _bytes(text), 0, hashlib.sha256()
            runs = _removed(starts.as_py(), len(data))
            for begin, end in runs:
                kept.update(data[at:begin])
                at = end
            kept.update(data[at:])
            out.append((len(data), sum(e - b for b, e in runs), [{"start": b, "end": e} for b, e in runs], kept.hexdigest()))
        columns = list(zip(*out)) or [[]] * 4
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]], ["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256"]
        )


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``spans``, ``kept_sha256`` per row of ``docs``.

    Every byte is removed that lies in a string of ``LENGTH`` bytes which also starts in a
    document with a smaller id. Null texts are empty; rows with a null id have no effect on
    others and lose what any other document has; rows with equal ids do not affect each
    other. Repeated rows keep a row each; other columns are not looked at. An empty table
    gives an empty result.
    """
    text = F.coalesce(col(text_column).cast("string"), F.lit(""))
    base = docs.select(F.col(id_column).cast("long").alias("doc_id"), text.alias("text"))
    # All uses of the texts start from this shuffle and need all its columns, so that it is shared.
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = base.withColumn("row", F.xxhash64("doc_id", "text")).repartition(partitions, "row")
    starts = repeated_strings(base)
    joined = base.join(starts, "row", "left").select("doc_id", "text", "starts")
    return joined.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept_sha256 string")
