import random
import time

import pytest
from pyspark.sql import functions as F
from llm_brute import line_chunks, lines_removed

from leafledger.llm import linechunks


def brute(rows, **cut):
    """Texts without repeated chunks, documents in order of id, and how many chunks they had."""
    texts = dict(rows)
    return {i: (t, len(list(line_chunks(texts[i].split("\n"), **cut)))) for i, t in lines_removed(texts, **cut).items()}


@pytest.mark.parametrize("options", [{}, {"window": 3, "divisor": 2}, {"window": 1, "divisor": 1}])
def test_against_brute_force(make, options):
    rng = random.Random(8)
    stock = [f"line number {i} with some more words" for i in range(30)] + ["", "short"]
    passage = [rng.choice(stock) for _ in range(12)]
    rows = []
    for i in range(60):
        body = [rng.choice(stock) if rng.random() < 0.5 else f"own {i} {rng.random()}" for _ in range(rng.randrange(1, 15))]
        if i % 3 == 0:
            at = rng.randrange(len(body) + 1)
            body[at:at] = passage
        rows.append((i, "\n".join(body)))
    rows += [(60, rows[0][1]), (61, "one line"), (62, "one line"), (63, "two\nlines"), (64, "two\nlines"), (65, "}\n\n}"), (66, "}\n\n}")]
    got = {r.doc_id: (r.text, r.n_chunks) for r in linechunks.without_repeated_chunks(make(rows), **options).collect()}
    assert got == brute(rows, **options)


def test_a_passage_shifted_by_a_line_is_found(make):
    passage = [f"passage line {i} of the text that moves" for i in range(40)]
    rows = [(1, "\n".join(["a"] + passage)), (2, "\n".join(["b", "c", "d"] + passage + ["e"]))]
    got = {r.doc_id: r.text for r in linechunks.without_repeated_chunks(make(rows)).collect()}
    assert got[1] == rows[0][1] and len(got[2]) < 0.4 * len(rows[1][1])


def test_odd_rows(odd):
    got = linechunks.without_repeated_chunks(odd)
    assert got.columns == [*odd.columns, "n_chunks", "n_removed"]
    assert sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == sorted((r.doc_id or 0, r.text or "") for r in odd.collect())
    assert got.where("text is null").count() == 2
    assert linechunks.without_repeated_chunks(odd.where("doc_id = -1")).count() == 0


def test_repeated_rows_and_null_ids(make):
    text = "\n".join(f"the line number {i} of a common text" for i in range(20))
    rows = [(None, text), (2, text), (2, text), (3, text)]
    got = linechunks.without_repeated_chunks(make(rows)).collect()
    assert len([r for r in got if r.doc_id is None and r.text == text]) == 1
    assert len({r.text for r in got if r.doc_id is not None}) == 1 and all(r.text != text for r in got if r.doc_id is not None)


def test_an_exact_copy_of_lines_is_emptied(make):
    rng = random.Random(3)
    texts = ["\n".join(rng.choice(("ab", "c", "", "long line with words")) + str(rng.randrange(50)) for _ in range(n)) for n in (2, 3, 4, 5, 9, 40, 700)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r.text for r in linechunks.without_repeated_chunks(make(rows)).collect()}
    assert all(got[100 + i] == "" for i in range(len(texts)))


def test_chunks_have_two_lines_or_more(make):
    rng = random.Random(5)
    rows = [(n, "\n".join(str(rng.random()) for _ in range(n))) for n in range(1, 120)]
    for r in make(rows).select("doc_id", linechunks.chunks(F.col("text")).alias("c")).collect():
        assert sum(c["size"] for c in r.c) == r.doc_id and (r.doc_id == 1 or min(c["size"] for c in r.c) >= 2)


def test_time_grows_with_the_lines(make):
    def seconds(lines):
        text = "\n".join(f"line {i} of a long text" for i in range(lines))
        docs = make([(1, text), (2, text + "\nmore"), (3, "x\n" + text)])
        start = time.perf_counter()
        linechunks.without_repeated_chunks(docs).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds(2000)
    assert seconds(64_000) < 4 * max(seconds(32_000), 1)
