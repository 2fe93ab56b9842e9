"""Queries over ids that lie far apart, up to above 2^31: each agrees with another that takes the same rows in one pass."""

import functools

import pytest
from pyspark.sql import functions as F

from leafledger.operators import profile as S
from leafledger.plans import registry
from leafledger.sources import tables

IDS = [*range(45), 32_700, *[k * 100_000_007 + j for k in (1, 2, 20, 39) for j in range(15)]]
DAY = 86_400_000_000


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("age-agree"))
    texts = {i: f"# title {i}\n\nif x == {i} {{ // note\n  for y in z:\n}}\n" + "word\n" * (i % 4) for i in IDS}
    rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    return root


@pytest.fixture(scope="module")
def rows_of(spark, folder):
    """The rows of a query, run once; times as microseconds, which Python's years do not bound."""

    @functools.cache
    def collect(name: str, frame=None) -> list:
        found = registry.QUERIES[name](spark, folder) if frame is None else frame
        times = {c: F.unix_micros(F.col(c).cast("timestamp")) for c, kind in found.dtypes if kind == "timestamp_ntz"}
        return found.withColumns(times).collect()

    return collect


def test_growth_closed_has_the_sums_of_all_windows_without_late_rows(rows_of):
    late = {r.mtime // DAY * DAY for r in rows_of("growth_late")}
    whole = {r.window_start: (r.window_end, r.files, r.size_bytes, r.tokens) for r in rows_of("corpus_growth")}
    got = {r.window_start: (r.window_end, r.files, r.size_bytes, r.tokens) for r in rows_of("growth_closed") if r.size_bytes}
    assert {d: v for d, v in got.items() if d not in late} == {d: v for d, v in whole.items() if d not in late}
    assert set(got) <= set(whole) and len(set(got) - late) > 20 and all(v[3] > 0 for v in got.values())


def test_growth_late_has_what_closed_windows_lack(rows_of):
    days = {}
    for r in rows_of("growth_late"):
        n, size = days.get(r.mtime // DAY * DAY, (0, 0))
        days[r.mtime // DAY * DAY] = n + 1, size + r.size_bytes
    assert sum(n for n, _ in days.values()) > 50
    for r in rows_of("growth_closed"):
        n, size = days.get(r.window_start, (0, 0))
        days[r.window_start] = n + r.files, size + r.size_bytes
    end = max(days)
    assert days.pop(end) == (1, 0)  # the row that the second batch brings
    assert days == {r.window_start: (r.files, r.size_bytes) for r in rows_of("corpus_growth")}


def test_mtime_distribution_is_that_of_the_report(rows_of):
    (got,) = rows_of("mtime_distribution")
    report = rows_of("profile_report")
    (total,) = [r for r in report if r.section == "total"]
    ages = {r.item: r.files for r in report if r.section == "age_bucket"}
    assert {label: got[label] for label, _ in S.AGE_BUCKETS} == {label: ages.get(label, 0) for label, _ in S.AGE_BUCKETS}
    assert (got.oldest_file, got.newest_file) == (total.oldest, total.newest) and total.files == len(IDS)


def test_profile_incremental_is_the_report_of_the_files_left(spark, folder, rows_of):
    left = tables.corpus(spark, folder).where("doc_id % 15 <> 0 OR doc_id % 30 = 0")
    whole = rows_of("", S.profile_report(S.condense(S.facts(left, registry.AS_OF))))
    got = rows_of("profile_incremental")
    assert sorted(got) == sorted(whole)
    (total,) = [r for r in got if r.section == "total"]
    assert total.files == sum(i % 15 > 0 or i % 30 == 0 for i in IDS) < len(IDS) and min(total.comments, total.tokens, total.code_lines) > 0
