import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from leafledger.operators import profile as S
from leafledger.sources import tables
from leafledger.streaming import late
from leafledger.streaming import stats as ST


@pytest.fixture
def arriving(spark, sf_dir, tmp_path):
    """The corpus as three files in a folder, and as a stream of one file per batch."""
    files = tables.corpus(spark, sf_dir).select("relpath", "size_bytes", "mtime", "text")
    files.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = (
        spark.readStream.schema(files.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    )
    return files, stream, tmp_path


def drain(frame, name, mode, tmp_path):
    query = (
        frame.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start()
    )
    query.awaitTermination()


def test_running_statistics(spark, arriving):
    files, stream, tmp_path = arriving
    drain(ST.corpus_stats_stream(stream), "running", "complete", tmp_path)
    got = {r.extension: (r.files, r.size_bytes) for r in spark.table("running").where("extension <> ''").collect()}
    f = S.facts(files, with_lines=False)
    assert got == {r.extension: (r.files, r.size_bytes) for r in S.extension_counts(f).collect()}
    total = S.basic_stats(f).first()
    ours = spark.table("running").agg(F.sum("tokens"), F.sum("text_files"), F.sum("files")).first()
    assert tuple(ours) == (total.estimated_tokens, total.text_files, total.total_files)


def test_growth_equals_batch(spark, arriving):
    files, _, tmp_path = arriving
    sentinel = spark.createDataFrame(
        [("end", 0, dt.datetime(2099, 1, 1), "")], files.schema
    )
    files.coalesce(1).write.parquet(f"{tmp_path}/day1")
    sentinel.coalesce(1).write.mode("append").parquet(f"{tmp_path}/day1")
    stream = spark.readStream.schema(files.schema).parquet(f"{tmp_path}/day1")
    drain(ST.corpus_growth(stream), "growth", "append", tmp_path)
    got = sorted(tuple(r) for r in spark.table("growth").collect())
    batch = ST.corpus_growth(files)
    assert got == sorted(tuple(r) for r in batch.collect()) and len(got) > 1


def test_late_files_are_dropped(spark, tmp_path):
    schema = "relpath string, size_bytes long, mtime timestamp_ntz, text string"
    day = lambda n: dt.datetime(2024, 1, n)
    batches = [[("a", 1, day(1), "x"), ("b", 1, day(9), "x")], [("late", 1, day(1), "x"), ("c", 1, day(10), "x")]]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        query = (
            ST.corpus_growth(stream).writeStream.format("parquet").outputMode("append")
            .option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/progress")
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
    rows = spark.read.parquet(f"{tmp_path}/out").orderBy("window_start").collect()
    assert [(r.window_start, r.files) for r in rows] == [(day(1), 1)]


def test_drained_growth_has_every_window(spark, arriving):
    files, stream, tmp_path = arriving
    got = ST.drain(ST.corpus_growth(stream, delay=None), f"{tmp_path}/drained", ["window_start", "window_end"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, ST.corpus_growth(files).collect()))


@pytest.mark.parametrize("zone", ["Asia/Tokyo", "America/New_York"])
def test_windows_do_not_depend_on_the_drivers_zone(spark, zone, monkeypatch):
    rows = spark.sql("SELECT 'a' AS relpath, 1L AS size_bytes, 'x' AS text, timestamp_ntz'2024-01-02 03:04:05' AS mtime")
    monkeypatch.setenv("TZ", zone)
    time.tzset()
    try:
        start = ST.corpus_growth(rows).selectExpr("cast(window_start AS string)").first()[0]
    finally:
        monkeypatch.undo()
        time.tzset()
    assert start == "2024-01-02 00:00:00"


def test_late_rows_have_their_own_table(spark, tmp_path):
    schema = "relpath string, size_bytes long, mtime timestamp_ntz, text string"
    day = lambda n, hour=0: dt.datetime(2024, 1, n, hour)
    batches = [
        [("a", 1, day(1), "x"), ("b", 2, day(3), "x"), ("c", 3, day(5), "x")],
        [("late", 4, day(2, 23), "x"), ("in-time", 5, day(4, 5), "x"), ("d", 6, day(20), "x")],
        [("later", 7, day(5), "x"), ("again", 8, day(3), "x"), ("e", 9, day(19), "x")],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/in")
        late.drain_growth(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out")
    late.drain_growth(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out")
    rows = late.late_rows(spark, f"{tmp_path}/out").collect()
    assert {r.relpath: r.batch for r in rows} == {"late": 1, "later": 2, "again": 2}
    got = {r.window_start.day: (r.files, r.size_bytes, r.is_closed) for r in late.windows(spark, f"{tmp_path}/out").collect()}
    assert got == {1: (1, 1, True), 3: (1, 2, True), 5: (1, 3, True), 4: (1, 5, True), 20: (1, 6, False), 19: (1, 9, False)}


def test_no_batch_yet(spark, tmp_path):
    assert late.windows(spark, f"{tmp_path}/none").collect() == [] and late.late_rows(spark, f"{tmp_path}/none").collect() == []
