import hashlib
import random
import zlib

import pytest
from leafledger.llm import periods
from leafledger.llm.queries import QUERIES


def plain_runs(words):
    """All runs by trying every period at every place."""
    out = []
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q) and not any(
                all(words[k] == words[k + r] for k in range(i, j + q - r)) for r in range(1, q)
            ):
                out.append((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_words(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def plain_row(doc_id, text):
    words = plain_words(doc_id, text)
    runs = plain_runs(words)
    lost = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(((-length, s, q) for s, length, q in runs), default=None)
    kept = b" ".join(w for i, w in enumerate(words) if i not in lost)
    sums = [hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), hashlib.sha256(kept)]
    four = (best[1], -best[0], best[2], -1000 * best[0] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *four, *(x.hexdigest() for x in sums))


def random_words(rng, letters, size):
    words = []
    while len(words) < size:
        part = [rng.choice(letters) for _ in range(rng.randint(1, 9))]
        words += part * rng.choice((1, 1, 1, 2, 3, 6, 14))
        if rng.random() < 0.2 and len(words) > 8:  # a longer stretch again, with a change
            words += words[-rng.randint(4, len(words)) :]
    return words[:size]


def test_runs_equal_brute_force_on_random_words():
    rng = random.Random(3)
    documents = [random_words(rng, [b"a", b"b", b"c"][: rng.randint(1, 3)] + [b"%d" % i for i in range(rng.choice((0, 0, 20)))], rng.randint(0, 130)) for _ in range(250)]
    found = periods.runs_of_documents(documents)
    assert sum(len(r) for r in found) > 300
    for words, runs in zip(documents, found):
        assert [tuple(r) for r in runs.tolist()] == plain_runs(words), words


def test_all_runs_come_from_lyndon_roots_without_condensing():
    rng = random.Random(4)
    import numpy as np

    for _ in range(150):
        words = random_words(rng, [0, 1, 2], rng.randint(1, 60))
        found = periods._runs_of(np.array(words))
        assert [tuple(r) for r in found.tolist() if r[1] >= 12] == sorted(plain_runs(words))


def test_suffix_tree_orders_suffixes_and_gives_extensions():
    import numpy as np

    rng = random.Random(5)
    for _ in range(60):
        symbols = [rng.randint(1, 3) for _ in range(rng.randint(1, 50))] + [0]
        tree = periods.SuffixTree(symbols)
        tree.prepare()
        places = range(len(symbols))
        assert tree.order().tolist() == sorted(places, key=lambda i: symbols[i:])
        assert tree.order(opposite=True).tolist() == sorted(places, key=lambda i: [-s if s else -9 for s in symbols[i:]])
        pairs = [(i, j) for i in places for j in places if i < j]
        got = tree.extension(np.array([i for i, _ in pairs], int), np.array([j for _, j in pairs], int))
        for (i, j), k in zip(pairs, got.tolist()):
            assert symbols[i : i + k] == symbols[j : j + k] and symbols[i + k] != symbols[j + k]


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    found = QUERIES["op13_periodic_runs"](spark, sf_dir).collect()
    assert len(found) == len(docs)
    assert any(r.n_runs > 1 for r in found)
    small = {d.doc_id: d.text for d in docs if d.text is None or len(d.text) < 6000}
    ours = {r.doc_id: tuple(r) for r in found}
    assert len(small) > 100
    for doc_id, text in small.items():
        assert ours[doc_id] == plain_row(doc_id, text)


def test_odd_rows(spark, odd):
    rows = {}
    for r in periods.run_digests(periods.with_repeated_tail(odd)).collect():
        rows.setdefault(r.doc_id, []).append(r)
    empty = hashlib.sha256(b"").hexdigest()
    for i in (1, 2, 3):
        assert [tuple(r)[1:] for r in rows[i]] == [(0, None, None, None, None, empty, empty)]
    assert len(rows[None]) == 2 and len(rows[5]) == 2 and rows[5][0] == rows[5][1]
    wide = rows[7][0]
    assert (wide.n_runs, wide.start, wide.length, wide.period, wide.exponent_milli) == (1, 0, 40_000, 1, 40_000_000)
    assert wide.collapsed_sha256 == hashlib.sha256(b"wide").hexdigest()
    assert rows[8][0].n_runs == 0
    assert rows[10][0].collapsed_sha256 == hashlib.sha256(" ".join("Ünï é中文 \U0001f389 \x00 end".split(" ")).encode()).hexdigest()


def test_other_columns_pass_and_empty_tables(make):
    docs = make([(1, "a b " * 10), (2, None)]).selectExpr("*", "1 AS runs", "'x' AS collapsed")
    found = periods.periodic_runs(docs)
    assert found.columns == ["doc_id", "lang", "source", "n_chars", "runs", "collapsed", "runs_", "collapsed_"]
    one = found.where("doc_id = 1").head()
    assert one.collapsed_ == "a b" and [tuple(r) for r in one.runs_] == [(0, 20, 2)]
    assert periods.run_digests(make([])).collect() == []


@pytest.mark.parametrize("blank", ["\t", "\n", "\x0b", "\x0c", "\r", " "])
def test_blanks_split_and_others_do_not(make, blank):
    text = blank.join(["x y", "b "] * 6)
    row = periods.periodic_runs(make([(1, text)])).head()
    assert row.collapsed == "x y b " and [tuple(r) for r in row.runs] == [(0, 12, 2)]
