"""Every registered analog against its DuckDB oracle (sf0.001 in CI; set
KINO_ORACLE_SF to run another scale)."""

import os

import pytest

import __spark_entry__ as entry_mod
from tests.oracle import compare, duck

SF_DIR = os.environ.get("KINO_ORACLE_SF", "/root/testdata/sf0.001")
Q = entry_mod.queries()
entry_mod.load_all()
SQL = {n: x for n, x in entry_mod.oracle_sql().items() if n in entry_mod.QUERIES}


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_oracle(spark, con, name):
    res = compare(Q[name](spark, SF_DIR), SQL[name], SF_DIR, con)
    assert res["ok"], res


@pytest.mark.parametrize("name", sorted(set(entry_mod.QUERIES) - set(SQL)))
def test_runs_without_oracle(spark, name):
    df = Q[name](spark, SF_DIR)
    assert df.count() >= 0
