from pyspark.sql import functions as F

from leafledger.operators import health
from leafledger.operators.paths import derive_entries, entry_columns


def listing(spark, items):
    return entry_columns(spark.createDataFrame(items, "relpath string, is_dir boolean"))


def test_presence(spark):
    items = [("readme.md", False), ("LICENSE", True), ("sub/.gitignore", False), ("test", True), ("a/b_test.go", False)]
    row = health.presence_checks(listing(spark, items)).first()
    assert (row.has_readme, row.has_license, row.has_gitignore, row.has_tests, row.has_test_files) == (
        True, False, False, True, True)


def test_presence_by_project(spark):
    items = [("p/README.md", False), ("p", True), ("q", True), ("q/tests", True), ("q/tests/x", False)]
    rows = {r.project: (r.has_readme, r.has_tests) for r in health.presence_checks(listing(spark, items), True).collect()}
    assert rows == {"p": (True, False), "q": (False, True)}


def test_files_beside_the_projects_are_no_projects(spark, corpus):
    items = [("README.md", False), ("p", True), ("p/x_test.go", False)]
    checks = health.presence_checks(listing(spark, items), True).collect()
    assert [(r.project, r.has_readme, r.has_test_files) for r in checks] == [("p", False, True)]
    row = health.health_check(corpus({"README.md": "x", "p/x_test.go": "y"}), listing(spark, items), by_top=True).collect()
    assert [r.project for r in row] == ["p"] and "No tests found" not in row[0].warnings


def test_no_entries(spark):
    row = health.presence_checks(listing(spark, []))
    assert row.first().has_readme is False


def test_empty_directories(spark):
    items = [("a", True), ("a/b", True), ("c", True), ("c/f", False)]
    assert [r.relpath for r in health.empty_directories(listing(spark, items)).collect()] == ["a/b"]


def test_large_files(corpus):
    files = corpus({"a": "x", "b": "x"}, {"a": 10 * 2**20, "b": 12_345_678})
    assert [r.label for r in health.large_files(files).collect()] == ["b (11.77MB)"]


def test_warnings_in_order(spark, corpus):
    files = corpus({"x/a": b"\x00", "x/b": "t"}, {"x/b": 11 * 2**20})
    entries = derive_entries(files).unionByName(listing(spark, [("void", True)]))
    row = health.health_check(files, entries).first()
    assert row.warnings == [
        "No README.md file found", "No LICENSE file found", "No .gitignore file found", "No tests found",
        "Large files detected: 1", "Empty directories: 1", "Binary files: 1 (consider adding to .gitignore)",
    ]
    good = listing(spark, [("README.md", False), ("license", False), (".gitignore", False), ("tests", True), ("tests/t", False)])
    assert health.health_check(files.where(F.lit(False)), good).first().warnings == []
