"""Every registered query against its SQL equivalent."""

import compare
import pytest

import __spark_entry__ as entry
from leafledger.plans import oracles, registry
from leafledger.sources import tables

QUERIES, SQL = registry.QUERIES, oracles.queries()


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    ours = compare.spark_rows(QUERIES[name](spark, sf_dir))
    theirs = compare.duck_rows(compare.connect(sf_dir), SQL[name])
    assert compare.differences(ours, theirs) is None


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("make", [tables.corpus, tables.page_corpus, tables.project_corpus, tables.sniff_corpus])
def test_a_path_identifies_a_file(spark, sf_dir, make):
    files = make(spark, sf_dir)
    assert files.count() == files.select("relpath").distinct().count() > 0
