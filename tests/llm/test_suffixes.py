import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from leafledger.llm import suffixes


def test_suffix_arrays():
    rng = random.Random(1)
    for _ in range(400):
        k = rng.choice([1, 2, 3, 26])
        text, breaks = b"", []
        for _ in range(rng.randrange(1, 6)):
            text += bytes(rng.randrange(97, 97 + k) for _ in range(rng.randrange(0, 15)))
            breaks.append(len(text))
            text += b"\0"
        symbols = [b + 2 for b in text]
        for at in breaks:
            symbols[at] = 1
        symbols[-1] = 0
        assert suffixes.suffix_array(text, breaks) == sorted(range(len(symbols)), key=lambda i: symbols[i:])


def test_every_string_has_an_anchor():
    rng = random.Random(2)
    for k in (1, 2, 26):
        data = bytes(rng.randrange(97, 97 + k) for _ in range(400))
        whole = np.frombuffer(data, np.uint8)
        inside = np.arange(whole.size) <= whole.size - suffixes.LENGTH
        places, hashes, least = suffixes.anchors(whole, inside)
        first, last = suffixes.owned(places, hashes, least)
        covered = np.zeros(whole.size, bool)
        for p, a, b in zip(places, first, last):
            assert 0 <= a <= b <= p and a >= p - suffixes.LENGTH + suffixes.ANCHOR
            covered[a : b + 1] = True
        assert (covered == inside).all()


def brute(rows):
    """Documents in order of id; those with one id do not affect each other."""
    out, seen = [], set()
    by_id = {}
    for doc_id, text in rows:
        by_id.setdefault(doc_id, []).append((text or "").encode())
    for doc_id in sorted(by_id, key=lambda i: (i is None, i or 0)):
        fresh = set()
        for data in by_id[doc_id]:
            covered = bytearray(len(data))
            for i in range(len(data) - 49):
                string = data[i : i + 50]
                fresh.add(string)
                if string in seen:
                    covered[i : i + 50] = b"\1" * 50
            spans = sum(1 for i in range(len(data)) if covered[i] and (not i or not covered[i - 1]))
            kept = bytes(b for b, c in zip(data, covered) if not c)
            out.append((doc_id, len(data), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
        seen |= fresh
    return sorted(out, key=str)


def found(docs):
    rows = suffixes.remove_repeats(docs).collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in rows), key=str)


@pytest.mark.parametrize("slice_", [1 << 21, 400])
def test_against_brute_force(make, monkeypatch, slice_):
    monkeypatch.setattr(suffixes, "SLICE", slice_)
    monkeypatch.setattr(suffixes, "HELD", slice_)
    rng = random.Random(slice_)
    words = ["alpha", "beta", "gamma", "é", "中文", "delta", "of", "the", "\n"]
    passage = " ".join(rng.choices(words, k=60))
    rows = []
    for i in range(60):
        text = " ".join(rng.choices(words, k=rng.randrange(0, 80)))
        if i % 3 == 0:
            a = rng.randrange(0, 100)
            text = text[: len(text) // 2] + passage[a : a + rng.randrange(45, 260)] + text[len(text) // 2 :]
        rows.append((i, text))
    near = list(rows[7][1] + passage)
    for i in range(60, 70):
        near[rng.randrange(len(near))] = "#"
        rows.append((i, "".join(near)))
    rows += [(70, rows[3][1]), (71, "a" * 49), (72, "a" * 50), (73, "a" * 51), (74, "a" * 300), (75, "ab" * 100), (76, "ba" * 60), (77, None)]
    rows += [(77, passage), (77, passage), (None, passage + "x"), (None, "q" * 60), (-3, "q" * 60)]
    assert found(make(rows)) == brute(rows)


def test_odd_rows(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert found(odd) == brute(rows)
    assert suffixes.remove_repeats(odd.where("doc_id = -1")).count() == 0


def spans_of(rows):
    """What Spark joins, in plain Python."""
    near = {(r[0], k) for r in rows if r[3] is None for k in range(r[1], r[2] + 1)}
    strings = {}
    for _, first, last, anchor, context, least, _ in (r for r in rows if r[5] is not None):
        strings.setdefault((anchor, context), []).append((first, last, least))
    for row, start, _, anchor, context, _, doc in (r for r in rows if r[6] is not None):
        near |= {(row, start + k) for f, t, least in strings.get((anchor, context), ()) if doc > least for k in range(f, t + 1)}
    return near


def test_places_beyond_what_a_task_holds_are_joined_later(monkeypatch):
    rng = random.Random(12)
    alphabet = [bytes(rng.choices(b"ab", k=3)) for _ in range(4)]
    contexts = sorted({b"".join(rng.choices(alphabet, k=rng.randrange(17, 26))) for _ in range(60)})
    rows = []
    for anchor in (-5, 3, 8):
        for context in contexts[:: 1 + anchor % 3]:
            for _ in range(rng.randrange(1, 4)):
                places = [(rng.randrange(50), rng.randrange(12), rng.randrange(10_000)) for _ in range(rng.randrange(1, 4))]
                rows.append((anchor, context, np.array(places, suffixes._place).tobytes()))
    kinds = [pa.int32(), pa.binary(), pa.binary()]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 7]), kinds)], ["anchor", "context", "places"]) for i in range(0, len(rows), 7)]

    def run():
        return [tuple(r.values()) for b in suffixes._match(iter(batches)) for r in b.to_pylist()]

    whole = run()
    assert all(r[3] is None for r in whole)
    monkeypatch.setattr(suffixes, "HELD", 200)
    parted = run()
    assert sum(r[6] is not None for r in parted) > 50
    assert spans_of(parted) == spans_of(whole)
    want = set()
    for anchor in (-5, 3, 8):
        least = {}
        for a, context, places in rows:
            if a == anchor:
                low = min(d for _, d, _ in np.frombuffer(places, suffixes._place).tolist())
                for k in range(len(context) - 49):
                    least[context[k : k + 50]] = min(low, least.get(context[k : k + 50], low))
        for a, context, places in rows:
            if a == anchor:
                for row, doc, start in np.frombuffer(places, suffixes._place).tolist():
                    want |= {(row, start + k) for k in range(len(context) - 49) if doc > least[context[k : k + 50]]}
    assert spans_of(whole) == want
