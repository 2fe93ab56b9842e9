import random

import pytest
from pyspark.sql import functions as F

from leafledger.functions import text as TX
from leafledger.operators import lines as L

SYNTAX = {
    "go": ("//", "/*", "*/"), "swift": ("//", "/*", "*/"), "py": ("#", None, None),
    "sql": ("--", "/*", "*/"), "html": (None, "<!--", "-->"), "zz": (None, None, None),
}


def brute_lines(text):
    if not text:
        return []
    parts = (text[:-1] if text.endswith("\n") else text).split("\n")
    return [p[:-1] if p.endswith("\r") else p for p in parts]


def brute_kinds(text, ext):
    prefix, start, end = SYNTAX[ext]
    kinds, inside = [], False
    for line in brute_lines(text):
        if not line.strip():
            kinds.append("blank")
        elif inside or (start and start in line):
            kinds.append("comment")
            inside = end not in line
        elif prefix and line.strip().startswith(prefix):
            kinds.append("comment")
        else:
            kinds.append("code")
    return kinds


@pytest.mark.parametrize("text", [
    "", "a", "a\n", "a\n\n", "\n", "\r", "\r\n", "a\r\nb\r", "a\n\r", "a\r\r\n", "a\rb\n", "\n\n\na", "x\r\n\r\n",
])
def test_split_and_count(corpus, text):
    files = corpus({"f.txt": text})
    got = [r.line for r in L.split_lines(files).orderBy("line_no").collect()]
    assert got == brute_lines(text)
    assert L.line_count(files).first().line_count == len(got)
    sizes = files.select(
        TX.numbered_bytes(F.col("content").cast("string")).alias("n"),
        TX.plain_bytes(F.col("content").cast("string")).alias("p")).first()
    assert sizes.p == sum(len(x.encode()) + 1 for x in got)
    assert sizes.n == sum(len(("%2d | %s\n" % (i + 1, x)).encode()) for i, x in enumerate(got))


def test_numbered_bytes_of_many_lines(corpus):
    for n in (9, 10, 99, 100, 999, 1000, 12345):
        text = "é\n" * n
        got = corpus({"f": text}).select(TX.numbered_bytes(F.col("content").cast("string")).alias("n")).first().n
        assert got == sum(len("%2d | é\n" % i) + 1 for i in range(1, n + 1))


def test_random_comments_agree_with_a_line_loop(spark, corpus):
    rng = random.Random(5)
    pieces = ["", " ", "\t", "x", "x = 1 ", "/*", "*/", "//", "#", "--", "<!--", "-->", "/* a */", " // /* y", " "]
    files = {}
    for n in range(600):
        ext = rng.choice(list(SYNTAX))
        body = "\n".join("".join(rng.choices(pieces, k=rng.randrange(0, 3))) for _ in range(rng.randrange(0, 14)))
        files[f"{n}.{ext.upper() if n % 5 == 0 else ext}"] = body
    df = corpus(files)
    want = {(p, i + 1): k for p, t in files.items() for i, k in enumerate(brute_kinds(t, p.split(".")[1].lower()))}
    from_files = {(r.relpath, r.line_no): r.kind for r in L.classify_lines(df).collect()}
    from_rows = {(r.relpath, r.line_no): r.kind for r in L.classify_line_rows(L.split_lines(df)).collect()}
    assert from_files == want
    assert from_rows == want
    for r in L.file_metrics(df).collect():
        kinds = [k for (p, _), k in want.items() if p == r.relpath]
        assert (r.lines, r.code_lines, r.blank_lines, r.comments) == (
            len(kinds), kinds.count("code"), kinds.count("blank"), kinds.count("comment"))


def test_complexity(corpus):
    text = "func main() {\n\tif x {\n\tfor i := 0; i < 3; i++ {\n// \tif y {\n/* \tif z { */\n}\n\twhile(x) {\nif a {\n\tfunc f () { if b { }\n"
    # lines 1 and 9 hold a function head, lines 2, 3 and 9 a control line
    row = L.file_metrics(corpus({"a.go": text})).first()
    assert row.complexity_score == 0.5 + 1 + 1 + 1.5
    assert (row.lines, row.comments, row.code_lines) == (9, 2, 7)


def test_long_lines(corpus):
    files = corpus({"ok.go": "a" * 65535 + "\nb", "long.go": "a" * 65536 + "\nb", "cr.go": "a" * 65535 + "\r\nb"})
    assert {r.relpath: r.lines for r in L.file_metrics(files).collect()} == {"ok.go": 2, "long.go": 2, "cr.go": 2}
    assert L.file_metrics(corpus({"wide.js": "x " * (1 << 19) + "\n//y"})).first().comments == 1
    flagged = {r.relpath for r in L.split_lines(files).where("line_too_long").collect()}
    assert flagged == {"long.go", "cr.go"}


def test_files_without_extension_have_no_metrics(corpus):
    assert L.file_metrics(corpus({"Makefile": "x"})).count() == 0


def test_numbering(corpus):
    rows = L.split_lines(corpus({"a": "x\n" * 100}))
    texts = [r.numbered for r in L.number_lines(rows).orderBy("line_no").collect()]
    assert (texts[0], texts[9], texts[99]) == (" 1 | x", "10 | x", "100 | x")
    assert L.number_lines(rows, "markdown").where("line_no = 1").first().numbered == "1 | x"
    assert L.number_lines(rows, None).first().numbered == "x"


def test_classification_needs_no_shuffle(spark, sf_dir):
    from leafledger.sources import tables

    plan = L.classify_lines(tables.page_corpus(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
