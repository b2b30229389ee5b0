"""Some registered queries against their SQL on the smallest data set."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_module

SF = "/root/testdata/sf0.001"
NAMES = ["detect_after_hours", "detect_attack_chain", "anchored_windows", "read_cef", "sigma_rules", "incidents"]

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def test_entry_runs(spark):
    assert sum(r.n for r in entry_module.entry(spark).collect()) > 0


def test_every_oracle_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert len(entry_module.queries()) > 90


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    got = entry_module.queries()[name](spark, SF).toPandas()
    want = con.execute(entry_module.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns

    def rows(df):
        return sorted(tuple(map(str, r)) for r in df[columns].itertuples(index=False))

    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["late_events", "stream_batch_scan"])
def test_stream_queries_match_sql(spark, con, name):
    test_query_matches_sql(spark, con, name)
