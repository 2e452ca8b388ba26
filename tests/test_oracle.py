"""Every registered query against its DuckDB oracle (the driver's gate, on the small scale)."""

import pytest

from conftest import SF_SMALL

import __spark_entry__ as entry_mod
from tessera.oracle import compare, duck_connect, rows_of_duck, rows_of_spark
from tessera.queries import load_all

QUERIES, ORACLE = load_all()


@pytest.fixture(scope="module")
def duck():
    return duck_connect(SF_SMALL)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert len(QUERIES) >= 50
    assert set(QUERIES) <= set(entry_mod.queries()) and set(ORACLE) <= set(entry_mod.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    got = rows_of_spark(QUERIES[name](spark, SF_SMALL))
    exp = rows_of_duck(duck, ORACLE[name])
    res = compare(got, exp)
    assert res["match"], res


def test_entry_smoke(spark):
    df = entry_mod.entry(spark)
    assert df.count() >= 0
    assert df.columns == ["event_type", "target_table", "strategy", "row_count", "sum_k", "tenants",
                          "first_event_time", "last_event_time"]
