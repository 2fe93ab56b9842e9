import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafledger.operators import health, profile as S
from leafledger.operators.select import Selection, select_files
from leafledger.sources import files as A


FILES = ["__init__.py", "__tests__/x.js", "_config.yml", "notes.txt", "sub/deep/leaf.json", "sub/read.md"]


@pytest.fixture
def tree(tmp_path):
    for name in (*FILES, ".hidden", ".dot/in.txt"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(f"content of {name}\n")
    (tmp_path / "void").mkdir()
    (tmp_path / "raw.bin").write_bytes(bytes([0, 1, 2, 255]))
    return str(tmp_path)


def test_read_corpus(spark, tree, paths_of):
    files = A.read_corpus(spark, tree)
    assert paths_of(files) == sorted([*FILES, "raw.bin"])
    row = files.where("relpath = 'notes.txt'").first()
    assert (row.size_bytes, bytes(row.content), row.warning) == (21, b"content of notes.txt\n", None)
    assert paths_of(A.read_corpus(spark, f"file:{tree}")) == paths_of(files)
    listed = A.list_entries(spark, tree).where("not is_dir")
    assert paths_of(listed) == paths_of(files)


def test_names_that_are_not_utf8(spark, tmp_path, paths_of):
    folder = os.fsencode(tmp_path) + b"/caf\xe9"
    os.mkdir(folder)
    with open(folder + b"/\xff.txt", "wb") as out:
        out.write(b"inside")
    files = A.read_corpus(spark, str(tmp_path))
    assert [(r.relpath, bytes(r.content)) for r in files.collect()] == [("caf\\xe9/\\xff.txt", b"inside")]


def test_an_unreadable_file_keeps_its_row(spark, tree):
    entries = A.list_entries(spark, tree)
    os.remove(f"{tree}/notes.txt")
    row = A.load_contents(entries, tree).where("relpath = 'notes.txt'").first()
    assert row.content is None and "notes.txt" in row.warning and row.size_bytes == 21


def test_listing(spark, tree, paths_of):
    shown = A.list_entries(spark, tree)
    assert paths_of(shown) == [
        "__init__.py", "__tests__", "__tests__/x.js", "_config.yml", "notes.txt", "raw.bin", "sub", "sub/deep",
        "sub/deep/leaf.json", "sub/read.md", "void"]
    assert [r.relpath for r in health.empty_directories(shown).collect()] == ["void"]
    assert S.directory_count(shown).first()[0] == 5
    hidden = paths_of(A.list_entries(spark, tree, include_dotfiles=True))
    assert {".hidden", ".dot", ".dot/in.txt"} < set(hidden)


def test_dotfiles_are_loaded(spark, tree, paths_of):
    files = A.read_corpus(spark, tree, include_dotfiles=True)
    assert ".dot/in.txt" in paths_of(files) and "void" not in paths_of(files)
    assert bytes(files.where("relpath = '.hidden'").first().content) == b"content of .hidden\n"


def test_whole_directory(spark, tree, paths_of):
    files = A.read_corpus(spark, tree)
    row = S.basic_stats(S.facts(files)).first()
    assert (row.total_files, row.text_files, row.binary_files) == (7, 6, 1)
    assert "raw.bin" not in paths_of(select_files(files, Selection()))


def test_unreadable_and_missing(spark, tree):
    with pytest.raises(NotADirectoryError):
        A.list_entries(spark, f"{tree}/nowhere")
    with pytest.raises(NotADirectoryError):
        A.list_entries(spark, f"{tree}/notes.txt")
    work = pa.RecordBatch.from_arrays([pa.array([b"gone"]), pa.array([None], pa.list_(pa.binary()))], ["raw", "names"])
    listed = [row for batch in A._walk(tree, False, 100)(iter([work])) for row in batch.to_pylist()]
    assert [row["relpath"] for row in listed] == ["gone"] and listed[0]["warning"]


def test_a_directory_with_a_warning_is_not_empty(spark):
    rows = [("a", "", True, None), ("b", "", True, "denied")]
    listed = spark.createDataFrame(rows, "relpath string, parent string, is_dir boolean, warning string")
    assert [r.relpath for r in health.empty_directories(listed).collect()] == ["a"]


def test_an_address_is_listed_like_a_path(spark, tree, paths_of, monkeypatch):
    found = list(A._scan_remote(f"file://{tree}", b"", False))
    assert sorted(r[0] for r in found) == sorted(r[0] for r in A._scan_mounted(os.fsencode(tree), b"", None, False))


def test_deep_listing_is_complete(spark, tmp_path, paths_of):
    deep = tmp_path
    for level in range(6):
        deep = deep / f"d{level}"
    deep.mkdir(parents=True)
    (deep / "leaf").write_text("x")
    listed = A.list_entries(spark, str(tmp_path))
    assert listed.count() == 7
    assert listed.agg(F.max("depth")).first()[0] == 7
    assert os.path.basename(listed.orderBy(F.desc("depth")).first().relpath) == "leaf"


def test_a_walk_needs_rounds_by_work_and_not_by_level(spark, tmp_path, monkeypatch):
    deep = tmp_path
    for i in range(60):
        deep = deep / f"d{i}"
    deep.mkdir(parents=True)
    (deep / "end").write_text("x")
    assert len(A._rounds(spark, str(tmp_path), False)) == 1
    wide = tmp_path / "wide"
    wide.mkdir()
    for i in range(700):
        (wide / f"n{i}").write_text("y" * (i % 5))
    monkeypatch.setattr(A, "FIRST_NAMES", 20)
    monkeypatch.setattr(A, "PART_NAMES", 50)
    rounds = A._rounds(spark, str(tmp_path), False)
    assert len(rounds) <= 4
    # names of the wide directory are looked at by many tasks
    parts = rounds[0].where("todo AND names IS NOT NULL").collect()
    assert sum(len(r.names) for r in parts) == 650 and len(parts) == 13
    got = {(r.relpath, r.is_dir, None if r.is_dir else r.size_bytes) for r in A.list_entries(spark, str(tmp_path)).collect()}
    want = set()
    for where, folders, names in os.walk(tmp_path):
        at = os.path.relpath(where, tmp_path)
        want |= {(os.path.normpath(os.path.join(at, f)), True, None) for f in folders}
        want |= {(os.path.normpath(os.path.join(at, n)), False, os.path.getsize(os.path.join(where, n))) for n in names}
    assert got == want
