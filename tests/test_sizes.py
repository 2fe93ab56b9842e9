import pytest
from pyspark.sql import functions as F

from leafledger.functions.sizes import parse_size, size_column
from leafledger.functions.text import megabytes
from leafledger.operators import select

# every unit in three spellings, with and without blanks around and inside
GOOD = {
    f"{before}{number}{inside}{spelt}{after}": number * factor
    for factor, unit in ((1, "b"), (1024, "kb"), (1024**2, "mb"), (1024**3, "gb"))
    for spelt in (unit, unit.upper(), unit.title())
    for number in (0, 3, 77)
    for before, inside, after in (("", "", ""), ("  ", " ", "\t"))
} | {"": 0, "   ": 0, "4096": 4096, "00012": 12, str(2**63 - 1): 2**63 - 1}
BAD = ["7 pb", "kb", "12,5", "3.0gb", "+4", "-2 b", "0x10", "5 k b", "1 2", "9" * 20, "2kbs"]


@pytest.mark.parametrize("text, size", GOOD.items())
def test_good(text, size):
    assert parse_size(text) == size


@pytest.mark.parametrize("text", BAD)
def test_bad(text):
    with pytest.raises(ValueError):
        parse_size(text)


def test_column_form(spark):
    rows = spark.createDataFrame([(t,) for t in [*GOOD, *BAD]], "t string")
    got = {r.t: r.n for r in rows.select("t", size_column(F.col("t")).alias("n")).collect()}
    assert got == {**GOOD, **dict.fromkeys(BAD)}


def test_max_size(corpus, paths_of):
    files = corpus({"a": "x", "b": "y", "c": "z"}, {"a": 1024, "b": 1025, "c": 2**21})
    assert paths_of(select.max_size(files, "1KB")) == ["a"]
    assert paths_of(select.max_size(files, 0)) == ["a", "b", "c"]
    assert paths_of(select.max_size(files, None)) == ["a", "b", "c"]


def test_megabytes_rounds_ties_to_even(spark):
    sizes = [0, 131072, 393216, 5 * 1024**2, 1024**2 + 1, 52429, 10 * 1024**3 + 7]
    rows = spark.createDataFrame([(s,) for s in sizes], "s long")
    got = rows.select("s", megabytes(F.col("s"), 2).alias("two"), megabytes(F.col("s"), 1).alias("one"))
    for r in got.collect():
        assert r.two == "%.2f" % (r.s / 1024**2)
        assert r.one == "%.1f" % (r.s / 1024**2)


def test_quota_of_a_hot_source(spark, paths_of):
    rows = [(f"hot/{i}", "hot", i) for i in range(500)] + [("bad/1", "bad", 9999), ("free/1", "free", 9999)]
    files = spark.createDataFrame(rows, "relpath string, source string, size_bytes long")
    quotas = spark.createDataFrame([("hot", "99B"), ("bad", "1.5MB")], "source string, quota string")
    kept = select.quota_join(files, quotas, "source")
    assert len(paths_of(kept)) == 102
    assert [r.relpath for r in kept.where("quota_invalid").collect()] == ["bad/1"]
