"""Rows with times of ids as large as those of a table of 1 GB, written and read again, against whole numbers in Python."""

import pytest
from pyspark.sql import functions as F

from leafledger.plans import registry

MINUTE, DAY = 60_000_000, 86_400_000_000
REACH = (2**63 - 1) // MINUTE
NOW, END = 1_709_251_200_000_000, 4_070_908_800_000_000  # 2024-03-01 and 2099-01-01
IDS = [*range(40), 100, 101, 723, 725, 9_999, 32_620, 32_621, 51_281, *range(392_070, 392_082), 448_721, 448_722, *range(512_810, 512_820)]


def at(i: int) -> int:
    return NOW - i * i % (REACH + 1) * MINUTE


def size(i: int) -> int:
    return len(f"text {i}\n")


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    """The rows of a query written as Parquet; times as microseconds, which Python's years do not bound."""
    root = str(tmp_path_factory.mktemp("age-rows"))
    rows = [(i, f"text {i}\n", "en", f"src{i % 3}", size(i)) for i in IDS]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")

    def run(name: str) -> list:
        registry.QUERIES[name](spark, root).write.parquet(f"{root}/out/{name}")
        found = spark.read.parquet(f"{root}/out/{name}")
        times = {c: F.unix_micros(F.col(c).cast("timestamp")) for c, kind in found.dtypes if kind == "timestamp_ntz"}
        return found.withColumns(times).collect()

    return run


def late_ids() -> set[int]:
    """Those whose window had ended, a day of delay included, before their batch came; the second batch has a time in 2099."""
    first = max(at(i) for i in IDS if i % 3 == 0)
    marks = {0: None, 1: first, 2: END}
    return {i for i in IDS if i % 3 and (at(i) // DAY + 2) * DAY <= marks[i % 3]}


def test_growth_closed(written):
    days = {END // DAY * DAY: [1, 0, False]}
    for i in set(IDS) - late_ids():
        day = days.setdefault(at(i) // DAY * DAY, [0, 0, True])
        day[0] += 1
        day[1] += size(i)
    got = written("growth_closed")
    assert {r.window_start: [r.files, r.size_bytes, r.is_closed] for r in got} == days and len(got) == len(days)
    assert all(r.window_end - r.window_start == DAY for r in got)


def test_growth_late(written):
    late = late_ids()
    assert sorted((r.mtime, r.size_bytes) for r in written("growth_late")) == sorted((at(i), size(i)) for i in late)
    assert max(late) > 392_076 > 32_621 > min(late)


def test_mtime_distribution(written):
    (got,) = written("mtime_distribution")
    bounds = [("last_24_hours", 0, 1), ("last_week", 1, 7), ("last_month", 7, 30), ("last_year", 30, 365), ("older", 365, 2**40)]
    assert {n: got[n] for n, _, _ in bounds} == {n: sum(low * DAY <= NOW - at(i) < high * DAY for i in IDS) for n, low, high in bounds}
    assert (got.oldest_file, got.newest_file) == (at(392_075), NOW) and at(392_075) == min(map(at, IDS))


def test_profile_incremental(written):
    left = [i for i in IDS if i % 15 or i % 30 == 0]
    got = {(r.section, r.item): r for r in written("profile_incremental")}
    total = got["total", ""]
    assert (total.files, total.size_bytes, total.oldest, total.newest) == (len(left), sum(map(size, left)), min(map(at, left)), NOW)
    older = [i for i in left if NOW - at(i) >= 365 * DAY]
    row = got["age_bucket", "older"]
    assert (row.files, row.size_bytes, row.oldest, row.newest) == (len(older), sum(map(size, older)), min(map(at, older)), max(map(at, older)))
