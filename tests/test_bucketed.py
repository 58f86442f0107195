"""Operators by series on bucketed tables: the same rows without a shuffle."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from larderflow.operators import fill, history
from larderflow.session import fresh_path
from larderflow.sources.bucketed import open_bucketed, series_session, write_bucketed

KEYS = ["store_id", "item_id"]
# W01 to W10, P07 and P08.
STEPS = {
    "lags": lambda df: history.with_lags(df, gap_free=True),
    "diffs": lambda df: history.with_diffs(df, gap_free=True),
    "rolling": lambda df: history.with_rolling(df, gap_free=True),
    "rolling sum and extremes": lambda df: history.with_rolling(df, windows=((7, ("sum", "min", "max")),), gap_free=True),
    "rolling past": lambda df: history.with_rolling(df, gap_free=True, exclude_current=True),
    "lags with gaps": lambda df: history.with_lags(df),
    "expanding": lambda df: history.with_expanding(df, functions=("mean", "std", "min", "max", "sum")),
    "ratios": lambda df: history.with_ratios(history.with_rolling(df, gap_free=True)),
    "price change": lambda df: history.with_price_change(df, gap_free=True),
    "forward fill": lambda df: fill.fill_series(df, backward=False),
    "backward fill": lambda df: fill.fill_series(df),
}


@pytest.fixture(scope="module")
def stored(spark):
    df = spark.range(6 * 400).selectExpr(
        "concat('s', id % 2) store_id", "concat('i', id % 6) item_id", "date_add(date'2020-01-01', cast(id div 6 as int)) date",
        "double(id * 7 % 11) sales", "if(id * 31 % 17 < 9, null, double(id * 13 % 29)) sell_price",
    )
    name, path = f"panel_{uuid.uuid4().hex[:8]}", fresh_path(spark, "bucketed")
    write_bucketed(df, name, path, 4)
    return df, name, path


@pytest.mark.parametrize("step", STEPS)
def test_same_rows_without_exchange(spark, stored, step):
    df, name, path = stored
    bucketed = STEPS[step](open_bucketed(series_session(spark), name, path, 4))
    plan = bucketed._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
    expected = STEPS[step](df)
    assert "Exchange" in expected._jdf.queryExecution().executedPlan().toString()

    def told(out):
        doubles = [c for c, kind in out.dtypes if kind == "double"]
        return out.withColumns({c: F.round(c, 9) for c in doubles}).select(*bucketed.columns).orderBy(*KEYS, "date").collect()

    assert told(bucketed) == told(expected)


def test_one_sorted_file_per_bucket_known_to_a_new_catalog(spark, stored):
    df, name, path = stored
    files = [r.f for r in spark.read.parquet(path).select(F.input_file_name().alias("f")).distinct().collect()]
    assert 1 < len(files) <= 4
    for file in files:
        rows = [(r.store_id, r.item_id, r.date) for r in spark.read.parquet(file).collect()]
        assert rows == sorted(rows)
    other = f"again_{uuid.uuid4().hex[:8]}"
    again = open_bucketed(series_session(spark), other, path, 4)
    assert again.count() == df.count() and "Exchange" not in STEPS["lags"](again)._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        write_bucketed(df, "none", path, 0)


def test_settings_of_the_first_session_stay(spark):
    before = spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition")
    own = series_session(spark)
    assert own.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "false"
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == before == "true"
