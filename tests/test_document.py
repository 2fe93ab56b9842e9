import json

from leafledger.operators.select import Selection
from leafledger.plans import document

FILES = {
    "a/one.py": 'print("x")\n\n\ttab "quoted" \\ back\n', "a/b/two.txt": "é 中   end", "empty.md": "", "z.bin": b"\x00\x01",
    "a/big.txt": "line of text\n" * 400, ".dot": "hidden\n", 'odd "name" \\ \n.txt': "x\r\ny\r\n",
}


def written(manifest, path):
    rows = manifest.orderBy("name").collect()
    parts = [(path / r.name).read_bytes() for r in rows]
    assert [len(p) for p in parts] == [r.bytes for r in rows]
    return json.loads(b"".join(parts)), rows


def test_parts_put_together_are_one_document(spark, corpus, tmp_path):
    for n, part_bytes in enumerate((64, 2000, 1 << 20)):
        path = tmp_path / f"doc{n}"
        blocks = document.json_blocks(corpus(FILES), Selection(exclude="*.bin"), limit=3000, max_file="4KB", root="r")
        got, rows = written(document.write_json_document(blocks, str(path), part_bytes), path)
        assert list(got) == ["metadata", "directory_tree", "files"]
        assert len(rows) > 8 if part_bytes == 64 else True
        files = {f["relative_path"]: f for f in got["files"]}
        assert [f["relative_path"] for f in got["files"]] == ["a/b/two.txt", "a/big.txt", "a/one.py", ".dot", "empty.md", 'odd "name" \\ \n.txt', "z.bin"]
        assert files["a/one.py"]["content"] == FILES["a/one.py"] or files["a/one.py"]["truncated"]
        assert files["a/b/two.txt"]["content"] == FILES["a/b/two.txt"] and files["a/b/two.txt"]["path"] == "r/a/b/two.txt"
        assert (files[".dot"]["skipped"], files[".dot"]["skip_reason"], files[".dot"]["content"]) == (True, "dotfile", "")
        assert (files["z.bin"]["skip_reason"], files["a/big.txt"]["skip_reason"]) == ("excluded", "too_large")
        assert got["metadata"]["total_files"] == 5 and got["metadata"]["options"]["character_limit"] == 3000
        lines = got["directory_tree"].split("\n")
        assert lines[0] == "├── a/" and lines[1] == "│   ├── b/" and lines[-1] == ""
        assert spark.read.parquet(f"{path}/{document.MANIFEST}").count() == len(rows)


def test_a_limit_marks_what_it_cuts(corpus, tmp_path):
    blocks = document.json_blocks(corpus({"a.txt": "one\ntwo\nthree\n", "b.txt": "four\n"}), limit=20)
    got, _ = written(document.write_json_document(blocks, str(tmp_path / "d")), tmp_path / "d")
    assert [(f["content"], f["truncated"]) for f in got["files"]] == [("one\ntwo\n", True), ("", True)]
    assert got["metadata"]["truncated"] is True


def test_a_corpus_without_files(corpus, tmp_path):
    blocks = document.json_blocks(corpus({"x": "y"}).where("false"))
    got, _ = written(document.write_json_document(blocks, str(tmp_path / "d")), tmp_path / "d")
    assert got["directory_tree"] == "" and got["files"] == [] and got["metadata"]["total_files"] == 0
