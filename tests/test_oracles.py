"""Every registered query at the smallest scale against its SQL twin."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    result = QUERIES[name](spark, SF_DIR)
    if name in ORACLES:
        assert compare(result, con, ORACLES[name]) == ""
    else:
        assert not result.isEmpty()


def test_entry_ranks_models(spark):
    rows = entry.entry(spark).collect()
    assert [r.WMAPE for r in rows] == sorted(r.WMAPE for r in rows)
    assert {r.model for r in rows} == {"naive", "seasonal_naive", "moving_avg_7", "moving_avg_28"}
    assert next(r for r in rows if r.model == "seasonal_naive").improvement_vs_baseline == "0.0%"
