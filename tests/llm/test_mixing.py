import random
from fractions import Fraction

import pytest

from leafledger.llm import mixing


def slots_of(spark, weights):
    sources = spark.createDataFrame([(s,) for s in weights], "source string")
    return [tuple(r) for r in mixing.schedule(mixing.source_weights(sources, weights, 1)).orderBy("slot").collect()]


@pytest.mark.parametrize("seed", range(4))
def test_every_source_stays_within_one_block_of_its_due(spark, seed):
    rng = random.Random(seed)
    weights = {f"s{i}": rng.randrange(1, 15) for i in range(rng.randrange(1, 9))}
    period = sum(weights.values())
    rows = slots_of(spark, weights)
    assert [r[3] for r in rows] == list(range(period))
    done = dict.fromkeys(weights, 0)
    for source, k, _, slot, nth in rows:
        assert nth == done[source] and nth * period // k <= slot < -(-(nth + 1) * period // k)
        done[source] += 1
        assert all(abs(done[s] - Fraction(w * (slot + 1), period)) < 1 for s, w in weights.items())
    assert done == weights


def test_blocks_follow_the_weights(make):
    rng = random.Random(3)
    rows = [(i, "x" * rng.randrange(0, 40), "en", "hot" if i % 3 else f"c{i % 4}") for i in range(900)]
    weights = {"hot": 3, "c0": 2}
    got = mixing.mix(make(rows), weights, 1, block_chars=50).collect()
    assert sorted(r.doc_id for r in got) == list(range(900))
    at = {}
    for r in sorted(got, key=lambda r: (r.source, r.place.offset, r.place.key)):
        assert r.place.offset == at.get(r.source, 0) and r.block == r.place.offset // 50 and r.release <= r.slot < r.deadline
        at[r.source] = r.place.offset + r.size
    owners = {}
    for r in got:
        assert owners.setdefault(r.slot, r.source) == r.source


def test_emitted_characters_stay_within_a_block_and_the_longest_document(make):
    rng = random.Random(5)
    weights, block = {"a": 3, "b": 2, "c": 1}, 50
    rows = [(i, "x" * (rng.randrange(150, 400) if i % 25 == 0 else rng.randrange(1, 40)), "en", "abc"[i % 3]) for i in range(600)]
    got = mixing.mix(make(rows), weights, 1, block_chars=block).collect()
    total, longest, most = dict.fromkeys(weights, 0), dict.fromkeys(weights, 0), 0
    for r in got:
        total[r.source] += r.size
        longest[r.source] = max(longest[r.source], r.size)
    for slot in range(max(r.slot for r in got) + 1):
        for s, k in weights.items():
            done = sum(r.size for r in got if r.source == s and r.slot <= slot)
            ahead = done - Fraction(k * (slot + 1) * block, sum(weights.values()))
            assert ahead < block + longest[s] and (ahead > -block or done == total[s])
            most = max(most, ahead)
    assert most > block  # one block alone is not the bound


def test_ranges_do_not_change_the_result(make, monkeypatch):
    rows = [(i, "y" * (i % 17), "en", "a" if i % 2 else "b") for i in range(300)]
    once = {tuple(r) for r in mixing.mix(make(rows), {"a": 2}).collect()}
    monkeypatch.setattr(mixing, "RANGE_ROWS", 20)
    assert {tuple(r) for r in mixing.mix(make(rows), {"a": 2}).collect()} == once


def test_files_follow_the_mixture(make, spark, tmp_path):
    rows = [(i, "z" * 30, "en", "a" if i % 3 else "b") for i in range(300)]
    docs = make(rows, extra=True)
    mixing.in_mixed_order(docs, {"a": 1, "b": 1}, block_chars=300).write.parquet(f"{tmp_path}/mixed")
    import glob

    import pyarrow.parquet as pq

    written = [r for f in sorted(glob.glob(f"{tmp_path}/mixed/*.parquet")) for r in pq.read_table(f).to_pylist()]
    assert sorted(r["doc_id"] for r in written) == list(range(300)) and list(written[0]) == docs.columns
    first = [r["source"] for r in written[:180]]
    assert abs(first.count("a") - first.count("b")) <= 20


def test_odd_rows(odd, make, spark):
    got = mixing.mix(odd, {"s": 2}, block_chars=100)
    assert sorted((r.doc_id or 0) for r in got.collect()) == sorted((r.doc_id or 0) for r in odd.collect())
    kept = mixing.in_mixed_order(odd, {"s": 2})
    assert kept.columns == odd.columns and kept.count() == odd.count()
    nulls = make([(1, "a", "en", None), (2, None, "en", "x")])
    assert mixing.mix(nulls, {}).count() == 2
    assert mixing.mix(odd.where("doc_id = -1"), {}).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(odd, {"s": 0})
    with pytest.raises(ValueError):
        mixing.schedule(mixing.source_weights(spark.createDataFrame([("s",)], "source string"), {"s": 1 << 30}, 1))
