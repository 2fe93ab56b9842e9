import os
import random

from pyspark.sql import functions as F

from leafledger.functions import linecodes
from leafledger.operators import blocks, lines
from leafledger.sources.files import read_corpus
from leafledger.sources.textlines import read_lines

LINE_STOCK = ["x = 1", "", "  ", "/* open", "close */", "/* one */", "// note", "// end */", "func go() {", " if a {", "func f( { for b {", "# note", "<!--", "-->", '"""']


def long_file(rng, size):
    return "\n".join(rng.choice(LINE_STOCK) for _ in range(size)) + "\n"


def test_blocks_equal_whole_files(spark, corpus):
    rng = random.Random(4)
    files = {f"d/f{i}.{ext}": long_file(rng, rng.choice((1, 7, 300))) for i in range(4) for ext in ("go", "py", "html", "txt", "css", "sh")}
    files |= {"no-extension": "a\nb", "empty.go": "", "open.go": "/*\n" + "in\n" * 400 + "*/\nout"}
    whole = corpus(files)
    want = {(r.relpath, r.line_no): r.kind for r in lines.classify_lines(whole).collect()}
    metrics = {tuple(r) for r in lines.file_metrics(whole).collect()}
    for size in (1, 3, 64, 1000):
        cut = blocks.line_blocks(whole, size).repartition(7)
        got = {(r.relpath, r.line_no): r.kind for r in blocks.classify_blocks(cut).collect()}
        assert got == want
        assert {tuple(r) for r in blocks.block_metrics(cut).collect()} == {m for m in metrics if m[0] != "empty.go"}
    rows = lines.classify_line_rows(lines.split_lines(whole).repartition(5)).collect()
    assert {(r.relpath, r.line_no): r.kind for r in rows} == want


def test_one_file_spans_ranges(spark):
    """A file with all the blocks is scanned by many tasks, and the state crosses them."""
    texts = spark.range(3000).selectExpr(
        "'big.go' AS relpath", "id AS block_no", "CASE id % 1000 WHEN 10 THEN '/*\n' WHEN 900 THEN 'x */\n' ELSE 'code\nmore\n' END AS text")
    coded = blocks.block_codes(texts)
    got = {r.block_no: r.codes for r in coded.collect()}
    for i in range(3000):
        at = i % 1000
        assert got[i] == ("s" if at == 10 else "i" if at == 900 else "ii" if 10 < at < 900 else "00"), i
    plan = blocks.block_codes(texts)._jdf.queryExecution().optimizedPlan().toString()
    assert "__bucket#" in plan[plan.index("windowspecdefinition("):][:200]


def test_transitions(spark):
    rows = spark.createDataFrame([("0b/", None), ("0s0", True), ("sp", False), ("ws", True), ("sq", False), ("", None)], "c string, want boolean")
    assert all(r.got == r.want for r in rows.select("want", linecodes.transition(F.col("c")).alias("got")).collect())


def test_lines_of_many_splits_are_numbered_as_whole_files(spark, tmp_path):
    rng = random.Random(6)
    content = {
        "big.txt": "".join(f"line {i} {'y' * rng.randrange(30)}{rng.choice(['', chr(13)])}\n" for i in range(4000)).encode(),
        "a b/ü%20#+?.py": b"one\r\ntwo\r\r\n\n\nlast\r",
        "long.md": b"start\n" + b"z" * 5000 + b"\nend",
        "empty.txt": b"",
        "blank.txt": b"\n\n",
        "_under/_score.txt": b"u\nv\n",
        "_k=1/part": b"w",
        "odd.bin": b"\xff\xfe\nab\x00c\n",
        ".hidden": b"h\n",
    }
    for name, data in content.items():
        os.makedirs(os.path.dirname(tmp_path / name), exist_ok=True)
        (tmp_path / name).write_bytes(data)
    other = spark.newSession()
    other.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    other.conf.set("spark.sql.shuffle.partitions", "4")
    for dotted in (False, True):
        whole = lines.split_lines(read_corpus(spark, str(tmp_path), dotted))
        want = sorted((r.relpath, r.line_no, bytes(r.line)) for r in whole.selectExpr("relpath", "line_no", "CAST(line AS BINARY) AS line").collect())
        read = read_lines(other, str(tmp_path), dotted)
        got = sorted((r.relpath, r.line_no, bytes(r.line)) for r in read.selectExpr("relpath", "line_no", "CAST(line AS BINARY) AS line").collect())
        assert got == want
    splits = other.read.text(str(tmp_path / "big.txt")).select(F.spark_partition_id().alias("p")).distinct().count()
    assert splits > 20


def test_texts_are_split_once(spark):
    """The plan of kinds starts from stored letters, so texts are read by one job only."""
    seen = spark.sparkContext.accumulator(0)
    texts = spark.range(200).selectExpr("'a.go' AS relpath", "id AS block_no", "'/*\n' AS text").repartition(3)
    counted = texts.mapInArrow(_counting(seen), "relpath string, block_no long, text string")
    assert blocks.classify_blocks(counted).count() == 200
    assert seen.value == 200


def _counting(seen):
    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return run


def test_conditions_on_paths_do_not_decode_them_per_line(spark, tmp_path):
    for name in ("a.txt", "b.txt"):
        (tmp_path / name).write_text("x\ny\n")
    rows = read_lines(spark, str(tmp_path)).where("relpath <> 'b.txt'")
    plan = rows._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert not [line for line in plan if "Filter" in line and "decode" in line]
    assert sorted((r.relpath, r.line_no, r.line) for r in rows.collect()) == [("a.txt", 1, "x"), ("a.txt", 2, "y")]
