import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from leafledger.operators import profile as S
from leafledger.plans.profile import profile

AS_OF = dt.datetime(2024, 3, 1)
FILES = {
    "memo.txt": "two words\n", "srv.go": "package srv\n", "docs/intro.md": "# Start\n",
    "logo.bin": bytes([137, 0, 7, 254]), "a.PY": "# c\nx = 1\n", "b.weird": "x", "c.odd": "y", "Makefile": "all:\n",
}


@pytest.fixture
def f(corpus):
    return S.facts(corpus(FILES))


def test_basic(f):
    row = S.basic_stats(f).first()
    assert (row.total_files, row.text_files, row.binary_files) == (8, 7, 1)
    assert row.total_size == sum(len(v) for v in FILES.values())
    assert S.basic_stats(f.limit(0)).first().asDict() == dict.fromkeys(
        ["total_files", "total_size", "text_files", "binary_files", "estimated_tokens"], 0)


def test_average(f):
    assert S.average_file_size(f).first()[0] == sum(len(v) for v in FILES.values()) / 8
    assert S.average_file_size(f.limit(0)).first()[0] == 0.0


def test_extensions(f):
    rows = [(r.extension, r.files) for r in S.extension_counts(f, 3).collect()]
    assert rows == [(".PY", 1), (".bin", 1), (".go", 1)]
    assert S.extension_counts(f).count() == 7
    assert "TakeOrderedAndProject" in S.extension_counts(f, 3)._jdf.queryExecution().executedPlan().toString()


def test_size_buckets_are_zero_filled(corpus):
    sizes = {"a": 0, "b": 1023, "c": 1024, "d": 10239, "e": 10240, "g": 2**20, "h": 10 * 2**20}
    got = {r.bucket: r.files for r in S.size_distribution(S.facts(corpus(dict.fromkeys(sizes, "x"), sizes))).collect()}
    assert got == {"0-1KB": 2, "1KB-10KB": 2, "10KB-100KB": 1, "100KB-1MB": 0, "1MB-10MB": 1, "10MB+": 1}


def test_age_edges(spark):
    day, tick = dt.timedelta(days=1), dt.timedelta(microseconds=1)
    ages = [-day, day * 0, day - tick, day, 7 * day - tick, 7 * day, 30 * day, 365 * day - tick, 365 * day]
    rows = spark.createDataFrame(
        [(f"f{i}", 1, "x", AS_OF - a) for i, a in enumerate(ages)],
        "relpath string, size_bytes long, text string, mtime timestamp_ntz")
    row = S.mtime_distribution(S.facts(rows, AS_OF)).first()
    assert (row.last_24_hours, row.last_week, row.last_month, row.last_year, row.older) == (3, 2, 1, 2, 1)
    assert (row.oldest_file, row.newest_file) == (AS_OF - 365 * day, AS_OF + day)


def test_complexity(f):
    row = S.complexity_totals(f).first()
    assert (row.total_lines, row.code_lines, row.comment_lines, row.blank_lines) == (8, 7, 1, 0)
    assert row.code_density == 7 / 8 * 100
    assert S.complexity_totals(f.limit(0)).first().code_density == 0.0
    shares = {r.ext_key: r.percentage for r in S.language_metrics(f).collect()}
    assert shares["py"] == 1 / 7 * 100 and len(shares) == 7


def test_complex_files(corpus):
    files = corpus({"long.go": "x\n" * 301, "edge.go": "x\n" * 300, "deep.go": "\tif a {\n" * 21, "flat.go": "\tif a {\n" * 20})
    assert sorted(r.relpath for r in S.complex_files(S.facts(files)).collect()) == ["deep.go", "long.go"]


def test_languages(f):
    rows = {r.language: r for r in S.language_stats(f).collect()}
    assert (rows["Other"].extension_count, rows["Python"].extension_count) == (3, 1)
    assert rows["Python"].percentage == 1 / 7 * 100
    assert rows["Other"].files == 3 and set(rows) == {"Other", "Python", "Go", "Markdown", "Text"}
    assert [r.language for r in S.top_languages(f, 2).collect()] == ["Other", "Go"]


def test_extensions_are_rows(f):
    rows = S.language_extensions(f).where("language = 'Other'").collect()
    assert sorted(r.extension for r in rows) == ["bin", "odd", "weird"]


@pytest.mark.parametrize("zone", ["Asia/Tokyo", "America/New_York"])
def test_ages_do_not_depend_on_the_drivers_zone(spark, zone, monkeypatch):
    monkeypatch.setenv("TZ", zone)
    time.tzset()
    try:
        times = spark.sql("SELECT id, timestamp_ntz'2024-03-01 00:00:00' - make_dt_interval(0, id * 12) AS mtime FROM range(6)")
        rows = times.selectExpr("'f' || id AS relpath", "1L AS size_bytes", "'x' AS text", "mtime")
        zoned = rows.withColumn("mtime", F.col("mtime").cast("timestamp"))
        for files in (rows, zoned):
            row = S.mtime_distribution(S.facts(files, AS_OF)).first()
            assert (row.last_24_hours, row.last_week) == (2, 4)
    finally:
        monkeypatch.undo()
        time.tzset()


def test_shares_read_the_corpus_once(spark, f):
    stats = S.language_metrics(f)
    stats.collect()
    assert "ReusedExchange" in stats._jdf.queryExecution().executedPlan().toString()


def test_condensed_facts_give_the_same_statistics(f):
    condensed = S.condense(f)
    for stat in (S.basic_stats, S.average_file_size, S.extension_counts, S.size_distribution, S.complexity_totals,
                 S.language_metrics, S.language_stats):
        assert sorted(map(str, stat(f).collect())) == sorted(map(str, stat(condensed).collect())), stat


def test_whole_profile(corpus):
    files = corpus(FILES).withColumn("mtime", F.lit(AS_OF).cast("timestamp_ntz"))
    found = profile(files, AS_OF, large=1)
    assert found["basic_stats"].first().total_files == 8
    assert found["directory_count"].first()[0] == 2
    assert found["health_check"].first().binary_files == 1
    assert found["large_files"].count() == 6
    assert found["mtime_distribution"].first().last_24_hours == 8
    totals = found["report"].where("section = 'total'").first()
    assert totals.files == 8 and totals.measured == 7 and totals.percentage == 100.0 and totals.newest == AS_OF
    for name in found.tables:
        found[name].collect()
    found.release()


def test_only_what_is_named_is_built(corpus):
    narrow = S.facts(corpus(FILES), only=("ext", "size_bytes"))
    assert narrow.columns == ["relpath", "files", "size_bytes", "ext"]
    whole = S.facts(corpus(FILES), with_lines=False)
    assert sorted(map(tuple, S.extension_counts(narrow).collect())) == sorted(map(tuple, S.extension_counts(whole).collect()))
