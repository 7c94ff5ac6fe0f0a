"""Registered queries against their SQL twins, on the smallest tables.

All of them run with FOLIOSEEK_ALL_QUERIES=1; tools/compare.py does the same from a shell.
"""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
import query_catalog
import query_oracles
from tools.compare import TABLES, rows_of

SF = "/root/testdata/sf0.001"
SOME = [
    "tokenize_space", "postings_by_field", "search_mixed", "search_not_only_batch", "bm25_topk_batch", "search_filtered_topk",
    "filter_values_and_ranges", "page_window", "coerce_types", "ingest_report", "read_csv", "partial_update", "stream_upsert",
    "time_format", "json_output",
]
NAMES = sorted(query_catalog.QUERIES) if os.environ.get("FOLIOSEEK_ALL_QUERIES") else SOME


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(want.columns, want.fetchall())


def test_every_query_has_sql():
    assert set(query_catalog.QUERIES) == set(query_oracles.ORACLES)


def test_import_needs_no_session():
    code = "import __spark_entry__ as e; e.queries(); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(entry.__file__))
