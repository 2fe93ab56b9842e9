import contextlib
import os
import threading

import numpy as np
import pytest

from leafledger.llm import gridjoin

SCHEMA = "vec_id long, embedding array<float>, label int, node string, component_id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], SCHEMA)


def brute(rows, threshold=0.95):
    good = {}
    for k, (i, v) in enumerate(rows):
        if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[k] = np.array(v, np.float32).astype(float)
    linked = {k: [m for m in good if m != k and len(good[m]) == len(good[k])
                  and good[k] @ good[m] / np.sqrt((good[k] @ good[k]) * (good[m] @ good[m])) >= threshold] for k in good}
    out = []
    for k, (i, _) in enumerate(rows):
        group, todo = {k}, [k]
        while todo:
            for m in linked.get(todo.pop(), []):
                if m not in group:
                    group.add(m)
                    todo.append(m)
        smallest = min((rows[m][0] for m in group if rows[m][0] is not None), default=None)
        out.append((i, len(linked.get(k, [])), smallest, i == smallest))
    return sorted(out, key=str)


@pytest.mark.parametrize("block, leaf", [(1024, 128), (16, 4)])
def test_against_all_pairs(spark, monkeypatch, block, leaf):
    monkeypatch.setattr(gridjoin, "BLOCK", block)
    monkeypatch.setattr(gridjoin, "LEAF", leaf)
    rng = np.random.default_rng(3)
    rows = []
    for c in range(12):
        centre = rng.normal(size=8)
        for _ in range(rng.integers(1, 25)):
            rows.append((len(rows), [float(x) for x in (centre + rng.normal(size=8) * 0.25).astype(np.float32)]))
    rows += [(500 + k, rows[3][1]) for k in range(40)]
    rows += [(600, None), (601, []), (602, [0.0] * 8), (603, [1.0, None] * 4), (604, [float("nan")] * 8), (605, [float("inf")] + [0.0] * 7)]
    rows += [(700, [1.0, 0.0]), (701, [2.0, 0.0]), (702, [1.0]), (703, [3.0]), (None, rows[0][1]), (3, rows[3][1]), (704, [1e30] + [0.0] * 7)]
    got = [tuple(r) for r in gridjoin.near_vectors(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_no_vectors(spark):
    assert gridjoin.near_vectors(frame(spark, [])).count() == 0
    assert [tuple(r) for r in gridjoin.near_vectors(frame(spark, [(1, None)])).collect()] == [(1, 0, 1, True)]


def test_distant_parts_are_skipped():
    a = np.eye(4)[[0] * 300]
    b = np.eye(4)[[1] * 300]
    sides = [gridjoin._Side(np.arange(300).tobytes(), np.ones(300, int).tobytes(), v.tobytes(), np.eye(4)) for v in (a, b)]
    of_a, of_b, forest = gridjoin.links_between(*sides, False, 0.95)
    assert not of_a.any() and not of_b.any() and not forest.stars()[0].size


def disk_of(spark, run):
    """Bytes of the local files that Spark makes meanwhile, those that it deletes again included."""
    folders = [f.getPath() for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    seen, ended = {}, threading.Event()

    def look():
        for path in (os.path.join(at, name) for folder in folders for at, _, names in os.walk(folder) for name in names):
            with contextlib.suppress(OSError):
                seen[path] = max(seen.get(path, 0), os.path.getsize(path))

    def watch():
        while not ended.wait(0.05):
            look()

    look()
    before = sum(seen.values())
    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        run()
    finally:
        ended.set()
        watcher.join()
    return sum(seen.values()) - before


def test_disk_does_not_grow_with_the_square_of_the_rows(spark, monkeypatch):
    monkeypatch.setattr(gridjoin, "BLOCK", 64)
    rng = np.random.default_rng(5)
    tables = [frame(spark, enumerate(rng.normal(size=(n, 64)).tolist())) for n in (1000, 4000)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the tables were large
    try:
        few, many = (disk_of(spark, lambda: gridjoin.near_vectors(vectors).collect()) for vectors in tables)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert many < 6 * few


@pytest.mark.parametrize("threshold", [0.5, 0.95, 0.999])
@pytest.mark.parametrize("length, spread", [(1, 1.0), (3, 0.1), (24, 0.3), (64, 0.05), (64, 0.3)])
def test_sketches_leave_out_no_link(monkeypatch, threshold, length, spread):
    monkeypatch.setattr(gridjoin, "PART", 16)
    rng = np.random.default_rng(length)
    units = gridjoin._unit(np.repeat(rng.normal(size=(10, length)), 20, axis=0) + spread * rng.normal(size=(200, length)))
    axes = np.linalg.qr(rng.normal(size=(length, length)))[0][:, : gridjoin._width(length)]
    a, b = (gridjoin._Sketches(k, length, gridjoin._sketch(units[k::2], axes)) for k in range(2))
    linked = units[0::2] @ units[1::2].T >= threshold
    own = units[0::2] @ units[0::2].T >= threshold
    np.fill_diagonal(own, False)
    space = np.empty(16 * 16, np.float32)
    of_a, of_b = gridjoin._possible(a, b, threshold, space)
    assert (of_a >= linked.any(axis=1)).all() and (of_b >= linked.any(axis=0)).all()
    of_a, of_b = gridjoin._possible(a, a, threshold, space)
    assert ((of_a | of_b) >= own.any(axis=1)).all()


def test_sketches_tell_unlike_vectors_apart():
    units = gridjoin._unit(np.random.default_rng(7).normal(size=(2000, 64)))
    sketches = gridjoin._Sketches(0, 64, gridjoin._sketch(units, np.eye(64)[:, : gridjoin._width(64)]))
    of_a, of_b = gridjoin._possible(sketches, sketches, 0.95, np.empty(gridjoin.PART**2, np.float32))
    assert (of_a | of_b).sum() < 100


def test_copies_in_several_partitions(spark):
    zero = [[0.0, 1.0], [-0.0, 1.0], [0.0, 2.0], [1.0, 0.0]]
    rows = [(k, zero[k % 4]) for k in range(80)] + [(k, None) for k in range(80, 90)]
    got = [tuple(r) for r in gridjoin.near_vectors(frame(spark, rows).repartition(7)).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_marked_classes_are_those_named(spark):
    rng = np.random.default_rng(9)
    nodes = [(int(block) << gridjoin.ROW_BITS) + int(row) for block in (0, 3, 5 << 20) for row in {0, 7, 8, 32767, *rng.integers(0, 32768, 200)}]
    every = spark.createDataFrame([(node, 1) for node in nodes], "node long, size long")
    some = nodes[::3]
    got = gridjoin._marked(every, spark.createDataFrame([(node,) for node in some + some[:9]], "node long"))
    assert got.columns == ["node", "size"] and sorted(r.node for r in got.collect()) == sorted(some)
