"""Every registered query against its DuckDB oracle on the smallest tables (the driver's check)."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from quillspark.plans.bridge import TABLES
from quillspark.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    import sys
    sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(__file__)), "scripts"))
    from oracle_check import value_hash
    df = QUERIES[name](spark, SF)
    srows = [tuple(r) for r in df.collect()]
    rel = con.execute(ORACLE[name])
    dcols = [d[0] for d in rel.description]
    drows = rel.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert value_hash(df.columns, srows)[0] == value_hash(dcols, drows)[0]


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert {"submission_id", "report", "truncated", "company", "accession"} <= set(df.columns)
