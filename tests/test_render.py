import glob
import html
import json

import pytest

from leafledger.operators import profile as S
from leafledger.operators import render as R
from leafledger.operators.paths import derive_entries
from leafledger.operators.select import Selection
from leafledger.plans.bundle import bundle
from leafledger.sources.sinks import UnsupportedFormat, output_format, write_bundle

GO = 'package main\n\nimport "fmt"\n\nfunc main() {\n\tfmt.Println("Hello, World!")\n}\n'


def block(df):
    return df.first().block


def test_text(corpus):
    files = corpus({"test.go": GO})
    got = block(R.render_text(files))
    assert got.startswith("\ntest.go:\n" + "-" * 80 + "\n 1 | package main\n 2 | \n 3 | import")
    plain = block(R.render_text(files, is_numbered=False))
    assert plain == "\ntest.go:\n" + "-" * 80 + "\n" + GO
    assert block(R.render_text(corpus({"e": ""}))) == "\ne:\n" + "-" * 80 + "\n"


@pytest.mark.parametrize("name, fence", [
    ("a.go", "go"), ("a.h", "c"), ("a.zsh", "bash"), ("a.weird", "weird"), ("Makefile", ""), ("a.PY", "PY"),
    ("a.log", "text"), ("x.dockerfile", "dockerfile"), (".gitignore", "gitignore"),
])
def test_markdown(corpus, name, fence):
    assert block(R.render_markdown(corpus({name: "x\ny"}))) == f"\n### {name}\n```{fence}\n1 | x\n2 | y\n```\n"


def test_html(corpus):
    line = """<a href="x">&amp; 'q'</a>"""
    got = block(R.render_html(corpus({"a&b.html": line})))
    escaped = html.escape(line).replace("&quot;", "&#34;").replace("&#x27;", "&#39;")
    assert f'<span class="line"><span class="line-number">1</span>{escaped}</span>\n' in got
    assert '<div class="file-header">a&amp;b.html</div>' in got
    assert f'<span class="line">{escaped}</span>\n' in block(R.render_html(corpus({"a": line}), is_numbered=False))


def test_export(corpus):
    row = R.export_files(corpus({"d/a.tar.gz": "x\ny"}), "/root/").first()
    assert (row.path, row.relative_path, row.extension, row.line_count, row.size_bytes) == (
        "/root/d/a.tar.gz", "d/a.tar.gz", "gz", 2, 3)


def test_metadata(spark, corpus):
    files = corpus({"a/b.txt": "x" * 9, "c": "y" * 3})
    git = spark.createDataFrame([("main", True)], "branch string, is_dirty boolean")
    row = R.export_metadata(
        S.basic_stats(S.facts(files)), S.directory_count(derive_entries(files)), files, extensions="go, md", extra=git
    ).first()
    assert (row.total_files, row.total_directories, row.estimated_tokens, row.total_size_bytes) == (2, 2, 2, 12)
    assert row.options.extensions_filter == ["go", "md"] and row.git_info.branch == "main"


def test_formats():
    assert output_format("TEXT") == "text"
    with pytest.raises(UnsupportedFormat):
        output_format("invalid")


def document(path):
    return "".join(open(p, encoding="utf-8").read() for p in sorted(glob.glob(f"{path}/part-*")))


def test_text_bundle_on_disk(corpus, tmp_path):
    files = corpus({"b.txt": "one\ntwo\n", "d/a.txt": "three\n", ".h": "no", "z.bin": b"\x00", "big": "q" * 99})
    spec = Selection(max_file_size=0)
    write_bundle(bundle(files, spec, max_file="50", limit=23), f"{tmp_path}/out")
    rule = "-" * 80
    assert document(f"{tmp_path}/out") == (
        "├── d/\n│   └── a.txt\n├── .h\n├── b.txt\n├── big\n└── z.bin\n\n"
        f"\nd/a.txt:\n{rule}\n 1 | three\n"
        f"\nb.txt:\n{rule}\n 1 | one\n[Output truncated: reached character limit of 23]\n"
        f"\nbig:\n{rule}\n[File too large: 0.0MB - skipped (max: 0.0MB)]\n"
    )


def test_markdown_bundle(corpus, tmp_path):
    write_bundle(bundle(corpus({"a.go": "x"}), format="Markdown"), f"{tmp_path}/out", "markdown")
    assert document(f"{tmp_path}/out") == (
        "# Project Structure\n\n## Directory Tree\n```\n└── a.go\n\n```\n\n## Files\n\n### a.go\n```go\n1 | x\n```\n")


def test_json_and_html_bundles(corpus, tmp_path):
    files = corpus({"a.go": "x\n<y>", "d/b": "z"})
    write_bundle(bundle(files, format="json"), f"{tmp_path}/json", "json")
    rows = [json.loads(line) for line in document(f"{tmp_path}/json").splitlines()]
    records = [json.loads(r["block"]) for r in rows if r["section"] == 3]
    head = json.loads(rows[0]["block"])
    assert rows[0]["section"] == 0 and (head["total_files"], head["total_directories"], head["text_files"]) == (2, 2, 2)
    assert [(r["relative_path"], r["line_count"]) for r in records] == [("d/b", 1), ("a.go", 2)]
    write_bundle(bundle(files, format="html"), f"{tmp_path}/html", "html")
    page = document(f"{tmp_path}/html")
    assert page.index("d/") < page.index("file-header") and "&lt;y&gt;" in page


def test_rendered_lines_match_the_count(spark, sf_dir):
    from leafledger.functions import text as TX
    from leafledger.sources import tables
    from pyspark.sql import functions as F

    files = tables.corpus(spark, sf_dir)
    counted = files.select("relpath", TX.line_count(F.col("text")).alias("n"))
    drawn = R.render_text(files).join(counted, "relpath").select(
        (TX.count_of(F.col("block"), "\n") - 3).alias("shown"), "n")
    assert drawn.where("shown <> n").count() == 0


def test_export_says_what_is_missing(corpus):
    files = corpus({"a.txt": "one\ntwo\n", "b.txt": "q" * 90, ".h": "x", "c.bin": b"\x00", "d.txt": "three\n"})
    rows = {r.relative_path: r for r in R.export_files(files, spec=Selection(), limit=10, max_file="50").collect()}
    assert {p: (r.skipped, r.skip_reason, r.truncated, r.content) for p, r in rows.items()} == {
        "a.txt": (False, "", True, "one\n"), "b.txt": (True, "too_large", False, ""), ".h": (True, "dotfile", False, ""),
        "c.bin": (True, "binary", False, ""), "d.txt": (False, "", True, ""),
    }
