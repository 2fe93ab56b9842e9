"""Times of documents whose squared ids reach further back than a timestamp."""

import pytest
from pyspark.sql import functions as F

from leafledger.plans import registry
from leafledger.sources import tables

REACH = (2**63 - 1) // 60_000_000
IDS = [0, 3, -3, 392_075, 392_076, 600_000, 3_100_000_000, -3 * 2**61, 2**63 - 1]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("ages"))
    rows = [(i, f"text {i}\n", "en", "src0", len(f"text {i}\n")) for i in IDS]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    return root


def test_times_are_kept_where_they_exist_and_start_again_beyond(spark, folder):
    minutes = F.timestamp_diff("MINUTE", F.col("mtime"), F.lit("2024-03-01 00:00:00").cast("timestamp_ntz"))
    got = {r[0]: r[1] for r in tables.corpus(spark, folder).select("doc_id", minutes).collect()}
    assert got == {i: i * i if i * i <= REACH else i * i % (REACH + 1) for i in IDS}
    assert tables.AGES == REACH + 1 and got[392_075] == 392_075**2 and got[392_076] == 722_495


@pytest.mark.parametrize("name", ["corpus_growth", "growth_closed", "growth_late", "mtime_distribution", "profile_report", "profile_incremental"])
def test_every_document_counts(spark, folder, name):
    rows = registry.QUERIES[name](spark, folder)
    if name.startswith("growth_"):  # with the sentinel of the second batch, a row is late or in a window
        late = registry.QUERIES["growth_late"](spark, folder).count()
        assert rows.count() == late if name == "growth_late" else rows.agg(F.sum("files")).first()[0] == len(IDS) + 1 - late
    elif name == "corpus_growth":
        assert rows.agg(F.sum("files"), F.sum("size_bytes")).first() == (len(IDS), sum(len(f"text {i}\n") for i in IDS))
    else:
        rows.write.format("noop").mode("overwrite").save()
