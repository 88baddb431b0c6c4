"""The registered queries: names, and SQL twins on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import rows

SMALL = os.environ.get("MILLRACE_TESTDATA", "/root/testdata/sf0.001")
# one query per family here; tools/check.py compares all of them
SAMPLE = ["group_stats", "an_zscore", "resample_linear", "join_multi_full", "expand_records", "validate_contract", "infer_fields", "quarantine_split"]


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in Path(SMALL).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    got = entry.queries()[name](spark, SMALL).toPandas()
    want = con.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
