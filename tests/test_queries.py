"""The registry itself, and a few registered queries against their SQL twins."""

from __future__ import annotations

import glob
import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_every_sql_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 140


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="tables are not there")
@pytest.mark.parametrize(
    "name", ["risk_band_shares", "daily_records", "moist_air", "climatology", "alert_states", "group_quantiles", "coverage_pairs", "subscription_matches"]
)
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from oracle_check import compare

    con = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    message, good = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SMALL)
    assert good, message


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="tables are not there")
def test_flagship_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["risk_colour", "n", "share"] and df.count() > 0
