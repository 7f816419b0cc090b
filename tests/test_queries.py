"""Every registered query against its oracle, on the smallest test data."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_DIR}/documents.parquet'")
    return connection


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(str, r)) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(entry.note_queries()))
def test_query(spark, duck, name):
    ours = rows(entry.queries()[name](spark, SF_DIR).toPandas())
    assert ours == rows(duck.execute(entry.oracle_sql()[name]).df())


def test_every_query_has_an_oracle():
    assert set(entry.note_queries()) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).columns == ["path", "reasons", "words"]
