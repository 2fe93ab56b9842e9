import datetime as dt

from pyspark.sql import functions as F

from leafledger.operators import profile as S
from leafledger.streaming import incremental

AS_OF = dt.datetime(2024, 3, 1)
SCHEMA = "relpath string, size_bytes long, mtime timestamp_ntz, text string"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def row(path, text, days):
    return path, len(text), AS_OF - dt.timedelta(days=days), text


BATCHES = [
    ([row("a.py", "x = 1\n", 0), row("b.py", "# c\n" * 400, 400), row("c.txt", "words here", 3), row("d.bin", "\x00" * 2000, 3)], []),
    ([row("a.py", "x = 1\ny = 2\n", 2), row("e.go", "func f() {\n}\n", 9)], ["b.py", "never-there"]),
    ([row("b.py", "back", 1), row("e.go", "", 9)], ["c.txt"]),
]


def run(spark, folder, batches, first=0):
    for number, (files, gone) in enumerate(batches, first):
        frame = spark.createDataFrame([(*f, False) for f in files] + [(g, None, None, None, True) for g in gone], SCHEMA + ", gone boolean")
        incremental.take_in(frame, folder, number, AS_OF, F.col("gone"))


def expected(spark, batches):
    now = {}
    for files, gone in batches:
        now |= {f[0]: f for f in files}
        now = {p: f for p, f in now.items() if p not in gone}
    return S.condense(S.facts(spark.createDataFrame(list(now.values()), SCHEMA), AS_OF))


def same(spark, folder, batches):
    got, want = incremental.condensed(spark, folder), expected(spark, batches)
    assert rows_of(got.select(sorted(got.columns))) == rows_of(want.select(sorted(got.columns)))
    assert rows_of(S.profile_report(got)) == rows_of(S.profile_report(want))


def test_every_batch_leaves_the_profile_of_the_files_as_they_are(spark, tmp_path):
    for n in (1, 2, 3):
        run(spark, f"{tmp_path}/{n}", BATCHES[:n])
        same(spark, f"{tmp_path}/{n}", BATCHES[:n])


def test_a_batch_run_again_counts_once(spark, tmp_path):
    run(spark, f"{tmp_path}/s", BATCHES)
    run(spark, f"{tmp_path}/s", BATCHES[2:], first=2)
    same(spark, f"{tmp_path}/s", BATCHES)


def test_compaction_changes_no_report_and_batches_go_on(spark, tmp_path):
    run(spark, f"{tmp_path}/s", BATCHES[:2])
    incremental.compact(spark, f"{tmp_path}/s", f"{tmp_path}/t", 1)
    same(spark, f"{tmp_path}/t", BATCHES[:2])
    run(spark, f"{tmp_path}/t", BATCHES[2:], first=2)
    same(spark, f"{tmp_path}/t", BATCHES)
    plain = incremental.condensed(spark, f"{tmp_path}/t", with_times=False)
    assert rows_of(S.basic_stats(plain)) == rows_of(S.basic_stats(expected(spark, BATCHES)))


def test_nothing_taken_in(spark, tmp_path):
    assert incremental.condensed(spark, f"{tmp_path}/none").collect() == []
