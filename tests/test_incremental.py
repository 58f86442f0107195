"""Day-by-day updates from a state table against the full build."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from larderflow.operators.history import add_rolling, diff_columns, lag_columns, price_change_column, with_expanding, with_ratios
from larderflow.operators.series import block_window, own_rows, with_blocks
from larderflow.plans import incremental
from larderflow.plans.incremental import HistoryFeatures
from larderflow.session import fresh_path
from larderflow.settings import FeatureSettings

DAY = dt.date(2020, 1, 1)
N = 50


def panel(spark, seed=0):
    """Series that begin and end at different days, with days missing, and values and prices that are null at times."""
    rng = random.Random(seed)
    rows = []
    for item, first, last in (("a", 0, N), ("b", 30, N), ("c", 0, 44), ("d", 48, N), ("e", 0, N)):
        for k in range(first, last):
            if item != "e" or k % 5:
                sales = None if rng.random() < 0.1 else float(rng.choice([0, 0, 0, rng.randint(1, 30)]))
                price = None if item == "c" else round(rng.uniform(1, 9), 2)
                rows.append(("s", item, DAY + dt.timedelta(k), sales, price, f"note {k}"))
    return spark.createDataFrame(rows, "store_id string, item_id string, date date, sales double, sell_price double, note string")


def full(df, exclude_current):
    s = FeatureSettings()
    w = block_window(("store_id", "item_id"), "date")
    out = with_expanding(df)
    out = with_blocks(out, ("store_id", "item_id"), "date", before=28)
    out = out.withColumns(lag_columns(w, "sales", s.lag_periods) | diff_columns(w, "sales", s.diff_periods) | price_change_column(w))
    return with_ratios(own_rows(add_rolling(out, w, "sales", s.rolling_windows, exclude_current)))


def as_dicts(df, names):
    return {(r.item_id, r.date): {n: r[n] for n in names} for r in df.collect()}


def same(a, b):
    assert a.keys() == b.keys()
    for key, row in a.items():
        for name, x in row.items():
            y = b[key][name]
            assert (x is None) == (y is None) and (x is None or x == y or math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)), (key, name, x, y)


@pytest.mark.parametrize("exclude_current", [True, False])
def test_updates_equal_the_full_build(spark, exclude_current):
    df, path, spec = panel(spark), fresh_path(spark, "incremental"), HistoryFeatures(exclude_current=exclude_current)
    whole = full(df, exclude_current)
    day = lambda k: F.lit(DAY + dt.timedelta(k))
    incremental.start(df.where(F.col("date") < day(40)), path, spec)
    for first, last in ((40, 41), (41, 42), (42, 46), (46, N)):
        incremental.update(df.where((F.col("date") >= day(first)) & (F.col("date") < day(last))), path, spec)
    built = spark.read.parquet(f"{path}/features")
    assert set(built.columns) == set(whole.columns)
    same(as_dicts(built, whole.columns), as_dicts(whole.where(F.col("date") >= day(40)), whole.columns))
    # The state is that of the whole history, and running the last days again changes nothing.
    state = lambda: {r.item_id: r.asDict() for r in spark.read.parquet(f"{path}/state").where(F.col("as_of") == day(N - 1)).drop("as_of").collect()}
    direct = {r.item_id: r.asDict() for r in incremental.initial_state(df, spec).collect()}
    before = state()
    assert before.keys() == direct.keys()
    for item, row in direct.items():
        assert row["last_values"] == before[item]["last_values"] and row["last_prices"] == before[item]["last_prices"]
        assert [before[item][c] for c in ("n", "total", "spread")] == pytest.approx([row[c] for c in ("n", "total", "spread")])
    incremental.update(df.where(F.col("date") >= day(46)), path, spec)
    assert state() == before
    same(as_dicts(spark.read.parquet(f"{path}/features"), whole.columns), as_dicts(whole.where(F.col("date") >= day(40)), whole.columns))


def test_beginning_without_history_and_refusing_old_days(spark):
    df, path = panel(spark, 1), fresh_path(spark, "incremental")
    early = df.where(F.col("date") < F.lit(DAY + dt.timedelta(3)))
    first = incremental.update(early, path)
    assert {r.lag_1 for r in first.where(F.col("date") == F.lit(DAY)).collect()} == {None} and first.count() == early.count()
    incremental.update(df.where(F.col("date") == F.lit(DAY + dt.timedelta(3))), path)
    with pytest.raises(ValueError, match="are built"):
        incremental.update(early, path)
    with pytest.raises(ValueError, match="no new days"):
        incremental.update(df.limit(0), path)


def test_an_update_scans_its_days_and_the_newest_state_only(spark):
    df, path = panel(spark, 2), fresh_path(spark, "incremental")
    incremental.start(df.where(F.col("date") < F.lit(DAY + dt.timedelta(45))), path)
    state = spark.read.parquet(f"{path}/state").where("as_of = date'2020-02-14'").drop("as_of")
    features, _ = incremental.advance(state, df.where(F.col("date") == F.lit(DAY + dt.timedelta(45))))
    plan = features._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Join") == 1 and plan.count("as_of") >= 1
