import random

import pytest
from pyspark.sql import functions as F

from leafledger.operators import budget


def brute(files, limit, numbered, biggest):
    """Kept lines per file and the files that lost lines, in tree order."""
    order = sorted(files, key=lambda p: [(i == p.count("/"), n) for i, n in enumerate(p.split("/"))])
    spent, kept, lost = 0, {}, []
    for path in order:
        if biggest and len(files[path].encode()) > biggest:
            continue
        body = files[path]
        lines = (body[:-1] if body.endswith("\n") else body).split("\n") if body else []
        kept[path] = 0
        for i, line in enumerate(lines):
            spent += len((("%2d | %s\n" % (i + 1, line)) if numbered else line + "\n").encode())
            if spent <= limit or limit <= 0:
                kept[path] += 1
        if kept[path] < len(lines):
            lost.append(path)
    return kept, sorted(lost)


@pytest.mark.parametrize("numbered", [True, False])
def test_random_corpora(corpus, numbered):
    rng = random.Random(4)
    files = {
        f"{'/'.join(rng.choices(['a', 'b', 'c'], k=rng.randrange(0, 3)) + [f'f{i}'])}":
        "".join(rng.choice(["é", "x" * 9, "", "long " * 7]) + "\n" for _ in range(rng.randrange(0, 30)))
        for i in range(120)
    }
    df = corpus(files)
    total = sum(len(t.encode()) for t in files.values())
    for limit in (0, 1, 500, total // 3, total, total * 4):
        kept, lost = brute(files, limit, numbered, 400)
        rows = budget.budget_cut(df, limit, numbered, "400").groupBy("relpath").count().collect()
        assert {r.relpath: r["count"] for r in rows} == {p: n for p, n in kept.items() if n}
        cut = budget.truncation_rows(df, limit, numbered, "400")
        assert sorted(r.relpath for r in cut.collect()) == lost


def test_edge_of_the_budget(corpus):
    files = corpus({"a": "xxx\nyyy\n", "b": "", "c": "z"})
    rows = budget.budget_cut(files, 8, is_numbered=False).collect()
    assert [(r.relpath, r.line_no, r.line) for r in rows] == [("a", 1, "xxx"), ("a", 2, "yyy")]
    notes = budget.truncation_rows(files, 8, is_numbered=False).collect()
    assert [tuple(r) for r in notes] == [("c", "[Output truncated: reached character limit of 8]")]


def test_too_large(corpus):
    files = corpus({"a": "x", "b": "y"}, {"a": 5 * 2**20})
    assert [tuple(r) for r in budget.too_large_rows(files, "1MB").collect()] == [
        ("a", "[File too large: 5.0MB - skipped (max: 1.0MB)]")]
    assert budget.too_large_rows(files).count() == 0


def test_group_budget_over_a_hot_group(spark):
    rng = random.Random(9)
    rows = [("hot" if i % 3 == 0 else f"g{i % 50}", i, "x" * rng.randrange(0, 20)) for i in range(1500)]
    df = spark.createDataFrame(rows, "k string, at int, text string")
    got = budget.budget_by(df, 300, "k", ["at"], F.octet_length("text"))
    spent, want = {}, set()
    for k, at, text in rows:
        spent[k] = spent.get(k, 0) + len(text)
        if spent[k] <= 300:
            want.add((k, at))
    assert {(r.k, r["at"]) for r in got.collect()} == want


@pytest.mark.parametrize("limit, sizes, kept", [
    (0, [100, 200, 300], 3), (1000, [100, 200, 300], 3), (500, [200, 200, 200], 2), (600, [200, 200, 200], 3), (100, [200], 0),
])
def test_running_limit(spark, limit, sizes, kept):
    df = spark.createDataFrame([(1, i, n) for i, n in enumerate(sizes)], "k int, at int, n long")
    assert budget.budget_by(df, limit, "k", ["at"], F.col("n")).count() == kept
