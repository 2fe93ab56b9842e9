import hashlib
import random

import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from leafledger.llm import iblt


WORD = regex.compile(r"(?V1)[ \t\n\x0b\f\r]*+[[\p{L}\p{M}\p{N}]--[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]]{1,24}+|[ \t\n\x0b\f\r]*.", regex.DOTALL)


def chained(values, seed=42):
    """Spark's hash of several strings: each is hashed with the hash before as seed."""
    for value in values:
        seed = xxhash.xxh64_intdigest(value.encode(), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def pieces(line):
    """A line is cut after a unit where the hash of the last four units is a multiple of eight."""
    units, piece = WORD.findall(line), []
    for i, unit in enumerate(units):
        piece.append(unit)
        if i == len(units) - 1 or (i >= 3 and chained(units[i - 3 : i + 1]) % 8 == 0):
            if any(u.strip(" ") for u in piece):
                yield tuple(piece)
            piece = []


def lines(text):
    return {p for line in (text or "").split("\n") if line.strip(" ") for p in pieces(line)}


def like(a, b):
    a, b = lines(a), lines(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def order(row):
    return (row[0] is not None, row[0] or 0)


def brute(rows):
    ranked = sorted(rows, key=order, reverse=True)
    out = {}
    for i, (doc_id, text) in enumerate(ranked):
        text, after = text or "", ranked[(i + 1) % len(ranked)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        out[doc_id] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), like(text, edited), like(text, after))
    return out


def found(docs):
    rows = iblt.compare_versions(docs).withColumn("e", F.sha2(F.col("edited").cast("binary"), 256)).collect()
    return {r.doc_id: (r.n_chars, r.e, pytest.approx(r.near_edited), pytest.approx(r.near_next)) for r in rows}, rows


def test_against_brute_force(make):
    rng = random.Random(2)
    stock = [f"paragraph {i}" for i in range(25)] + ["", " ", "é中🎉"]
    rows = [(i * 7 % 101, "\n".join(rng.choices(stock, k=rng.choice([0, 1, 2, 5, 30])))) for i in range(101)]
    words = ["".join(rng.choices("abcdefg", k=rng.randrange(1, 30))) for _ in range(60)] + ["中文字", "é", "#", "1,2"]
    rows += [(400 + i, "\n".join(" ".join(rng.choices(words, k=rng.randrange(1, 90))) for _ in range(rng.randrange(1, 5)))) for i in range(40)]
    rows += [(200, "\n".join(f"many {i}" for i in range(700))), (201, "\n".join(f"many {i}" for i in range(350, 900))), (300, rows[0][1]), (-4, "end")]
    got, full = found(make(rows))
    assert got == brute(rows)
    prints = {}
    for r in full:
        prints.setdefault(dict(rows)[r.doc_id], set()).add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values())


def test_ranges_hand_over_to_each_other(make, spark):
    rows = [(i, f"text {i}") for i in range(50)]
    for ranges in (1, 2, 7, 60):
        got = iblt.with_next(make(rows).select("doc_id", "text"), ranges).collect()
        assert {r.doc_id: r.next_text for r in got} == {i: f"text {(i - 1) % 50}" for i in range(50)}


def test_peeling_gives_back_both_sides(spark):
    a, b = list(range(0, 40)), list(range(5, 45))
    df = spark.createDataFrame([(a, b)], "a array<long>, b array<long>")
    cells = iblt.subtracted(iblt.sketch(F.col("a")), iblt.sketch(F.col("b")))
    got = {(r.k, r.n) for r in df.select(iblt.peeled(cells).alias("p")).first().p}
    assert got == {(i, 1) for i in range(5)} | {(i, -1) for i in range(40, 45)}
    much = spark.createDataFrame([(list(range(500)), list(range(500, 900)))], "a array<long>, b array<long>")
    assert much.select(iblt.peeled(iblt.subtracted(iblt.sketch(F.col("a")), iblt.sketch(F.col("b"))))).first()[0] is None
    larger = iblt.subtracted(iblt.sketch(F.col("a"), 2400, 5), iblt.sketch(F.col("b"), 2400, 5))
    assert {(r.k, r.n) for r in much.select(iblt.peeled(larger, 2400, 5).alias("p")).first().p} == {(i, 1 if i < 500 else -1) for i in range(900)}


def test_cells_are_counts_and_xors(spark):
    keys = [3, -9, 1 << 60, 77]
    got = spark.createDataFrame([(keys,)], "a array<long>").select(iblt.sketch(F.col("a"), 30, 2).alias("s")).first().s
    signed = lambda h: h - (1 << 64) if h >> 63 else h

    def hashed(key, salt):
        return signed(xxhash.xxh64_intdigest(salt.to_bytes(4, "little"), xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), 42)))

    cells = {}
    for key in keys:
        for j in range(3):
            n, k, h = cells.get(place := hashed(key, 2 + j) % 10 + 10 * j, (0, 0, 0))
            cells[place] = n + 1, k ^ key, h ^ hashed(key, 101)
    assert [tuple(c) for c in got] == [(p, *cells[p]) for p in sorted(cells)]


def test_every_difference_is_peeled(spark):
    """Sets of all sizes and overlaps: nothing but sketches tells how many digests differ."""
    rng = random.Random(9)
    rows = [([], []), ([1], []), (list(range(60)), list(range(60)))]
    for size in (1, 5, 18, 30, 100, 400, 3000):
        for shared in (0, size // 2, size - 1, size):
            own = rng.sample(range(-(1 << 60), 1 << 60), 2 * size)
            rows.append((own[:size], own[size - shared : 2 * size - shared]))
    df = spark.createDataFrame(rows, "a array<long>, b array<long>")
    a, b = F.col("a"), F.col("b")
    sketched = df.select("a", "b", iblt.sketch(a).alias("x"), iblt.sketch(b).alias("y"))
    got = sketched.select("a", "b", iblt.difference(a, b, F.col("x"), F.col("y")).alias("d"))
    assert "array_except" not in got._jdf.queryExecution().analyzed().toString()
    assert all(r.d == len(set(r.a) ^ set(r.b)) for r in got.collect())


def test_texts_of_one_line_keep_the_likeness_of_what_is_untouched(make):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 9)))
    rows = [(i, " ".join(word() for _ in range(400))) for i in range(8)]
    rows += [(i, "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(600))) for i in range(8, 12)]
    rows += [(20, rows[0][1]), (21, rows[0][1].replace(" ", " more ", 200).replace(" more ", " ", 199))]
    got = {r.doc_id: r for r in iblt.compare_versions(make(rows)).collect()}
    # two thirds stay: 2/3 shared of 4/3 distinct
    assert all(0.35 < got[i].near_edited < 0.65 for i in range(1, 12))
    assert all(got[i].near_next < 0.05 for i in range(1, 12))
    assert got[20].fingerprint == got[0].fingerprint and 0.9 < got[21].near_next < 1


def test_odd_rows(odd, make):
    assert iblt.compare_versions(odd).count() == odd.count()
    assert iblt.compare_versions(odd.where("doc_id = -1")).count() == 0
    got, _ = found(make([(1, "alone\nhere")]))
    assert got == brute([(1, "alone\nhere")])
    got, _ = found(make([(None, "a\nb\nc"), (2, None), (1, "")]))
    assert got == brute([(None, "a\nb\nc"), (2, None), (1, "")])


def test_large_differences_take_time_in_proportion(spark):
    """Tens of thousands of digests, which were once compared pair by pair."""
    a, b = F.sequence(F.lit(0), F.lit(59_999).cast("long")), F.sequence(F.lit(100), F.lit(50_000_000).cast("long"), F.lit(1000))
    df = spark.range(1).select(a.alias("a"), b.alias("b")).select("a", "b", iblt.fingerprint(F.col("a")).alias("x"), iblt.fingerprint(F.col("b")).alias("y"))
    both = len(set(range(60_000)) & set(range(100, 50_000_001, 1000)))
    assert df.select(iblt.difference(*[F.col(c) for c in "abxy"])).first()[0] == 60_000 + 50_000 - 2 * both


def test_a_fingerprint_is_the_sketch(spark):
    rows = [([],), ([5],), (list(range(-3, 400)),), ([2**63 - 1, -(2**63), 0],)]
    df = spark.createDataFrame(rows, "a array<long>")
    got = df.select(iblt.fingerprint(F.col("a")).alias("f"), iblt.sketch(F.col("a")).alias("s")).collect()
    assert all(r.f == r.s for r in got) and len(got) == 4


def test_texts_are_shuffled_once(make):
    docs = make([(i, f"line {i}\nline two of {i}\n") for i in range(50)])
    plan = iblt.compare_versions(docs)._jdf.queryExecution().toString()
    assert "RoundRobinPartitioning" not in plan.split("== Physical Plan ==")[1]
