import random

import pytest
from pyspark.sql import functions as F

from leafledger.operators import paths, select
from leafledger.operators.select import Selection
from leafledger.schema import MissingColumns

NAMES = ["app.go", "model.py", "guide.md", ".env", "draft.bak", "old_app.go", "data.json", "LICENSE"]


@pytest.fixture
def files(corpus):
    return corpus({n: "x" for n in NAMES})


def test_extensions(files, corpus, paths_of):
    assert paths_of(select.filter_extensions(files, "py")) == ["model.py"]
    assert paths_of(select.filter_extensions(files, " json,.go  , md ")) == ["app.go", "data.json", "guide.md", "old_app.go"]
    assert len(paths_of(select.filter_extensions(files, ""))) == len(NAMES)
    odd = corpus({"Big.PY": "x", "plainname": "x", "pack.tar.xz": "x", "dir.q/inner": "x"})
    assert paths_of(select.filter_extensions(odd, "py,xz,q")) == ["pack.tar.xz"]


def test_globs(files, corpus, paths_of):
    kept = select.filter_dotfiles(select.exclude_globs(files, "*.bak,old_*"))
    assert paths_of(kept) == ["LICENSE", "app.go", "data.json", "guide.md", "model.py"]
    assert paths_of(select.exclude_globs(corpus({"deep/in/here-it-is.log": "x"}), "here*")) == []
    assert len(paths_of(select.exclude_globs(files, "app[.go"))) == len(NAMES)


def test_dotfiles(corpus, paths_of):
    files = corpus({"a": "x", ".h/b": "x", "c/.d": "x", "e.f/g": "x"})
    assert paths_of(select.filter_dotfiles(files)) == ["a", "e.f/g"]
    assert paths_of(select.filter_dotfiles(files, "base")) == [".h/b", "a", "e.f/g"]


def test_tracked(spark, corpus, paths_of):
    files = corpus({p: "x" for p in ("lib/core.rs", "lib/core.rs.orig", "notes", "out/run.log")})
    tracked = spark.createDataFrame([("notes",), ("lib/core.rs",), ("gone.txt",)], "path string")
    assert paths_of(select.tracked_only(files, tracked)) == ["lib/core.rs", "notes"]
    assert len(paths_of(select.tracked_only(files, tracked.limit(0)))) == 4


def test_composed_selection_and_audit(spark, files, corpus, paths_of):
    assert len(paths_of(select.select_files(files, Selection(include_dotfiles=True)))) == len(NAMES)
    mixed = corpus({
        "a.go": "x", "b.tmp": "x", ".c": "x", "d.bin": b"\x00\x01", "e.go": "y" * 50, "f.zz": "x", "g.go": "x",
    })
    tracked = spark.createDataFrame([(p,) for p in ("a.go", "b.tmp", ".c", "d.bin", "e.go", "f.zz")], "path string")
    rules = spark.createDataFrame(
        [(1, "f.*", False, False)], "rule_no long, pattern string, is_negation boolean, is_dir_only boolean"
    )
    spec = Selection(exclude="*.tmp", tracked=tracked, rules=rules, max_file_size=10)
    assert paths_of(select.select_files(mixed, spec)) == ["a.go"]
    reasons = {r.reason: r.files for r in select.selection_audit(mixed, spec).collect()}
    assert reasons == {
        "selected": 1, "excluded": 1, "dotfile": 1, "binary": 1, "too_large": 1, "ignored": 1, "untracked": 1,
    }
    assert paths_of(select.dry_run_manifest(mixed, spec)) == ["a.go"]


def brute_is_text(name: str, data: bytes) -> bool:
    if name.endswith(".md"):
        return True
    head = data
    if not data:
        return True
    if 0 in head:
        return False
    valid = sum(len(c.encode()) for c in head.decode("utf-8", "ignore"))
    controls = sum(b < 32 and b not in b"\n\r\t\f\v\b" for b in head)
    return valid / len(head) >= 0.8 and controls / len(head) <= 0.3


def test_text_detection_on_random_bytes(corpus):
    rng = random.Random(7)
    files = {
        "plain": "Some text", "emoji": "héllo 🎉", "empty": "", "bin": bytes([0, 1, 2, 3, 255]),
        "nul": b"Some text\x00more", "nul.md": b"\x00", "late": b"a" * 600 + b"\x00",
        "cut": b"a" * 511 + "é".encode(), "cut3": b"a" * 510 + "€".encode(), "surrogate": b"\xed\xa0\x80" * 3,
        "replacement": "�" * 20, "eight": b"a" * 8 + b"\xff\xff", "seven": b"a" * 7 + b"\xff" * 3,
        "three": b"a" * 7 + b"\x01" * 3, "four": b"a" * 6 + b"\x01" * 4,
    }
    alphabet = [b"a", b"\xff", b"\xc3", b"\xa9", "é".encode(), "€".encode(), b"\xe2\x82", b"\x01", "�".encode(),
                b"\xf0\x9f\x8e", "🎉".encode(), b"\xc0\x80", b"\xf5", b"\xef\xbf"]
    for i in range(1500):
        weights = [rng.random() ** 3 + (8 if k == 0 else 0) for k in range(len(alphabet))]
        files[f"r{i}"] = b"".join(rng.choices(alphabet, weights, k=rng.randrange(1, 400)))
    got = {r.relpath: r.is_text for r in select.classify_text(corpus(files)).select("relpath", "is_text").collect()}
    for name, payload in files.items():
        data = payload if isinstance(payload, bytes) else payload.encode()
        assert got[name] is brute_is_text(name, data), (name, data)
    nuls = {r.relpath for r in select.nul_sniff(corpus(files)).where("is_binary").collect()}
    assert {"bin", "nul", "nul.md", "late"} <= nuls and "empty" not in nuls


def test_path_columns(corpus):
    rows = {r.relpath: r for r in paths.with_path_columns(
        corpus({n: "" for n in (".hidden", "a.tar.gz", "Makefile", "d/e.PY", "x.", "a.b/c")})).collect()}
    assert [rows[n].ext for n in (".hidden", "a.tar.gz", "Makefile", "d/e.PY", "x.", "a.b/c")] == [
        ".hidden", ".gz", "", ".PY", ".", ""]
    assert (rows["d/e.PY"].ext_key, rows["x."].ext_key, rows["Makefile"].ext_key) == ("py", "", None)
    assert (rows["d/e.PY"].dir, rows["d/e.PY"].base, rows["d/e.PY"].depth, rows["d/e.PY"].top) == ("d", "e.PY", 2, "d")


def test_missing_columns(spark):
    with pytest.raises(MissingColumns):
        select.filter_dotfiles(spark.range(1))


def test_path_filters_come_before_content(spark, sf_dir):
    from leafledger.sources import tables

    manifest = select.filter_extensions(tables.corpus(spark, sf_dir), "go").select("relpath")
    plan = manifest._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.split("ReadSchema")[1]
    assert manifest.where(F.col("relpath").contains("doc_")).count() > 0
