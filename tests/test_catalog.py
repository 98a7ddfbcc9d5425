"""Registered queries against their SQL equivalents. All of them with TRACKLORE_ALL_QUERIES=1, else one per area."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracle import compare

SAMPLE = [
    "monthly_summary", "discovery_context", "dedupe_mark", "ingest_report", "scan_json_history", "report_overview",
    "stream_ingest", "link_plays",
]
NAMES = list(entry.oracle_sql()) if os.environ.get("TRACKLORE_ALL_QUERIES") else SAMPLE


@pytest.fixture(scope="module")
def con(sf):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, sf, name):
    df = entry.queries()[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    cursor = con.execute(entry.oracle_sql()[name])
    problem = compare(rows, df.columns, cursor.fetchall(), [c[0] for c in cursor.description])
    assert problem is None, problem


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_equivalent_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
