import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from leafledger.llm import spelling
from leafledger.llm.queries import QUERIES


def plain_counts(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode()) if doc_id is not None else 1
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def plain_near(words):
    """Near words by what is left when a letter is taken out or masked."""
    keys = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            keys[w[:i] + "\0" + w[i + 1 :]].add(w)
            keys[w[:i] + w[i + 1 :]].add(w)
        keys[w].add(w)
    near = defaultdict(set)
    for key, group in keys.items():
        for a in group:
            for b in group:
                if a != b and ("\0" in key or key in (a, b)):
                    near[a].add(b)
    return near


def plain_variants(counts):
    near, form = plain_near(counts), {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 10 * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return out


def test_query_equals_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = plain_variants(plain_counts([tuple(r) for r in rows]))
    got = [tuple(r) for r in QUERIES["op11_spelling_variants"](spark, sf_dir).collect()]
    assert len(got) == len(want) > 1000 and set(got) == want
    assert sum(form is not None for _, form, *_ in got) >= 5


def words_like(rng, size):
    """Words with many near ones, anagrams, chains of forms, and letters beyond ASCII."""
    found = set()
    while len(found) < size:
        word = "".join(rng.choice("abcéÿ×") for _ in range(rng.randint(7, 9)))
        found.add(word)
        for _ in range(3):
            i = rng.randrange(len(word))
            found.add(rng.choice([word[:i] + word[i + 1 :], word[:i] + "a" + word[i:], word[:i] + "q" + word[i + 1 :], "".join(sorted(word))]))
    return {w: rng.choice((2, 3, 20, 35, 200, 2500, 40_000)) for w in found if len(w) >= 7}


def test_many_cells_lose_no_pair(spark):
    counts = words_like(random.Random(1), 1500)
    want = plain_variants(counts)
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert len(spelling._coarse_trees(words, 40)) >= 3
    for cell_words in (40, 10_000):
        assert {tuple(r) for r in spelling.variants(words, cell_words).collect()} == want
    assert any(form and root != form for _, form, root, *_ in want)


def test_one_edit_changes_counts_by_one_up_and_one_down():
    rng = random.Random(2)
    for _ in range(500):
        word = "".join(rng.choice("abcdefgh") for _ in range(rng.randint(7, 12)))
        i = rng.randrange(len(word))
        for other in (word[:i] + "z" + word[i + 1 :], word[:i] + "z" + word[i:]):
            a, b = (spelling._vectors(np.frombuffer(w.encode(), np.uint8)[None])[0].astype(int) for w in (word, other))
            assert abs(a - b).sum() <= 2 and (b - a).clip(0).sum() == 1 and (a - b).clip(0).sum() == len(word) + 1 - len(other)
            bits = [spelling._unary(x[None].astype(np.uint8))[0] for x in (a, b)]
            assert np.bitwise_count(bits[0] ^ bits[1]).sum() <= 2


def test_boxes_prune_but_keep_all_that_is_near():
    rng = np.random.default_rng(3)
    points = rng.integers(0, 3, (3000, spelling.DIMENSIONS), dtype=np.uint8)
    tree = spelling.Cells(points, 8)
    queries = points[:100].T.astype(np.int16)
    visited = defaultdict(set)
    for leaf, rows in tree.visits(queries, 1, 1):
        for row in rows.tolist():
            visited[row] |= set(tree.members[leaf].tolist())
    difference = points[None, :, :].astype(int) - points[:100, None, :]
    near = (difference.clip(0).sum(2) <= 1) & ((-difference).clip(0).sum(2) <= 1)
    for row in range(100):
        assert set(np.flatnonzero(near[row]).tolist()) <= visited[row]
    assert sum(map(len, visited.values())) < 100 * 3000 / 4


def test_odd_rows_and_empty_tables(make, odd):
    got = {r.word: r for r in spelling.spelling_variants(odd.union(odd)).collect()}
    assert got["x" * 120_000].n == 2 or got["x" * 119_999].n == 2
    assert got["without"].n == 2 and got["without"].root == "without" and got["without"].form is None
    assert spelling.spelling_variants(make([])).collect() == []
    assert spelling.spelling_variants(make([(1, None), (2, ""), (3, "short words")])).collect() == []


def test_long_words_one_letter_apart(make):
    word = "ab" * 30_000
    docs = make([(None, " ".join([word] * 20)), (None, word[:-1] + "x " + word[:-1] + "x"), (None, (word[:500] + word[501:] + " ") * 2)])
    got = {r.word: r for r in spelling.spelling_variants(docs).collect()}
    assert {w: (r.n, r.n_near) for w, r in got.items()} == {
        word: (20, 2), word[:-1] + "x": (2, 1), word[:500] + word[501:]: (2, 1),
    }
    assert all(r.root == word for r in got.values())
