import random

import numpy as np
import xxhash

from leafledger.llm import simhash
from leafledger.llm.components import connected_components


def print_of(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ")
             .replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    n = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + n]), 42) for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(prints):
    """Smallest id per connected group, by comparing all pairs."""
    root = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for i in prints:
            for j in prints:
                if (prints[i] ^ prints[j]).bit_count() <= 3 and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    return root


def test_spark_hashes_agree_with_the_contract(spark):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([("some text é",)], "t string").select(F.xxhash64("t")).first()[0]
    assert got % (1 << 64) == xxhash.xxh64_intdigest("some text é", 42)


def test_against_all_pairs(make):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(40)]
    texts = []
    for _ in range(25):
        base = rng.choices(vocabulary, k=rng.randrange(1, 60))
        texts.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            other = list(base)
            other[rng.randrange(len(other))] = rng.choice(vocabulary)
            texts.append(rng.choice([" ", "\t", "\n"]).join(other).upper() if rng.random() < 0.5 else " ".join(other))
    rows = list(enumerate(texts + ["", None, "  "]))
    got = {r.doc_id: r for r in simhash.simhash_groups(make(rows)).collect()}
    prints = {i: print_of(t) for i, t in rows}
    assert {i: r.fingerprint % (1 << 64) for i, r in got.items()} == prints
    assert {i: r.component_id for i, r in got.items()} == groups_of(prints)
    kept = simhash.keep_one_per_group(make(rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(groups_of(prints).values()))


def test_grid_finds_every_pair_of_random_fingerprints(spark):
    rng = random.Random(5)
    prints = []
    for _ in range(60):
        p = rng.getrandbits(64)
        prints += [p] + [p ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 6))) for _ in range(3)]
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in set(prints)]
    for segments in (1, 4, 5, 7):
        links = simhash.near_links(spark.createDataFrame(signed, "fingerprint long"), 3, segments)
        nodes = {r.node: r.component for r in connected_components(links, "a", "b").collect()}
        want = groups_of({s: s % (1 << 64) for (s,) in signed})
        assert {k: v for k, v in want.items() if list(want.values()).count(v) > 1} == nodes


def test_blocks_give_the_same_groups(monkeypatch):
    rng = np.random.default_rng(1)
    home = rng.integers(0, 1 << 10, 300, np.uint64)
    visitors = rng.integers(0, 1 << 10, 200, np.uint64)
    whole = simhash.forest_of_cell(home, visitors, 2)
    monkeypatch.setattr(simhash, "BLOCK", 64)
    parts = simhash.forest_of_cell(home, visitors, 2)
    assert [x.tolist() for x in whole] == [x.tolist() for x in parts]


def test_odd_rows(odd):
    rows = simhash.simhash_groups(odd).collect()
    assert len(rows) == odd.count()
    zero = {r.component_id for r in rows if r.fingerprint == 0}
    assert zero == {1}
    assert simhash.simhash_groups(odd.where("doc_id = -1")).count() == 0
    kept = simhash.keep_one_per_group(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.where("text = 'same text here'").collect()) == [5]


def test_one_row_per_group_for_null_and_repeated_ids(make):
    rng = random.Random(9)
    words = [f"w{rng.randrange(10 ** 6)}" for _ in range(900)]
    texts = {name: " ".join(words[300 * i : 300 * i + 300]) for i, name in enumerate("abc")}
    spaced = {name: text.replace(" ", "  ") for name, text in texts.items()}
    rows = [
        (None, texts["a"]), (None, spaced["a"]), (None, texts["a"]),  # only null ids
        (None, texts["b"]), (4, spaced["b"]), (9, texts["b"]),  # 4 heads this group
        (4, texts["c"]), (3, spaced["c"]), (3, texts["c"]), (3, texts["c"]),  # 4 heads no group here, 3 has two texts
    ]
    got = [(r.doc_id, " ".join(r.text.split())) for r in simhash.keep_one_per_group(make(rows)).collect()]
    assert sorted(got, key=str) == sorted([(None, texts["a"]), (4, texts["b"]), (3, texts["c"])], key=str)


def test_components_of_a_long_chain(spark):
    edges = spark.range(1, 200).selectExpr("id AS a", "id - 1 AS b")
    found = connected_components(edges, "a", "b").collect()
    assert len(found) == 200 and {r.component for r in found} == {0}
