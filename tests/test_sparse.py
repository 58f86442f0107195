"""Features from sparse facts against the gap-free panel."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest

from larderflow.operators.history import add_rolling, diff_columns, lag_columns, with_expanding, with_ratios
from larderflow.operators.reshape import densify
from larderflow.operators.series import block_window, own_rows, with_blocks
from larderflow.operators.sparse import sparse_features

START, END = "2020-01-01", "2020-05-09"
WINDOWS = ((7, ("mean", "std", "min", "max", "sum")), (28, ("mean", "std", "min", "max")), (14, ("mean",)))
KEYS = ("store_id", "item_id")


def facts(spark):
    rng = random.Random(4)
    rows = []
    for item, chance in (("often", 0.9), ("seldom", 0.05), ("some", 0.3), ("negative", 0.4)):
        for k in range(130):
            if rng.random() < chance:
                sales = None if rng.random() < 0.05 else float(rng.randint(1, 40)) * (-1 if item == "negative" and k % 3 == 0 else 1)
                rows.append(("s", item, dt.date(2020, 1, 1) + dt.timedelta(k), sales))
    rows.append(("s", "first day only", dt.date(2020, 1, 1), 5.0))
    return spark.createDataFrame(rows, "store_id string, item_id string, date date, sales double")


def dense(df, exclude_current):
    panel = with_expanding(densify(df, START, END), functions=("mean", "std", "min", "max", "sum"))
    w = block_window(KEYS, "date")
    out = with_blocks(panel, KEYS, "date", before=29, gap_free=True)
    out = out.withColumns(lag_columns(w, "sales", (1, 7, 14, 28)) | diff_columns(w, "sales", (1, 7)))
    return with_ratios(own_rows(add_rolling(out, w, "sales", WINDOWS, exclude_current)))


@pytest.mark.parametrize("exclude_current", [False, True])
def test_equal_to_the_gap_free_panel(spark, exclude_current):
    df, at = facts(spark), ["2020-01-01", "2020-02-20", END]
    built = sparse_features(
        df, START, diffs=(1, 7), windows=WINDOWS, expanding=("mean", "std", "min", "max", "sum"), exclude_current=exclude_current, at=at
    )
    want = {(r.item_id, r.date): r for r in dense(df, exclude_current).collect()}
    asked = {(r.item_id, r.date) for r in df.collect()} | {(i, dt.date.fromisoformat(d)) for i in {k[0] for k in want} for d in at}
    found = {(r.item_id, r.date): r for r in built.collect()}
    assert built.count() == len(found) and found.keys() == asked
    names = [c for c in built.columns if c not in (*KEYS, "date", "zero_run", "sales")]
    assert {"lag_28", "diff_7", "rolling_std_28", "expanding_std", "ratio_7_28"} <= set(names)
    for key, row in found.items():
        for name in names:
            a, b = row[name], want[key][name]
            assert (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-7)), (key, name, a, b)


def test_zero_runs_and_days_before_the_start(spark):
    day = lambda k: dt.date(2020, 1, 1) + dt.timedelta(k)
    rows = [("s", "a", day(3), 2.0), ("s", "a", day(4), 1.0), ("s", "a", day(9), None), ("s", "a", day(-2), 9.0), ("s", "a", None, 9.0)]
    df = spark.createDataFrame(rows, "store_id string, item_id string, date date, sales double")
    found = sparse_features(df, START, at=[END]).orderBy("date").collect()
    assert [(r.sales, r.zero_run, r.lag_1) for r in found] == [(2.0, 3, 0.0), (1.0, 0, 2.0), (0.0, 4, 0.0), (0.0, 119, 0.0)]
    assert sparse_features(df.limit(0), START, at=[END]).collect() == []
    with pytest.raises(ValueError, match="unknown function"):
        sparse_features(df, START, windows=((7, ("median",)),))


def test_one_shuffle_and_no_skeleton(spark):
    df = spark.range(100).selectExpr("'s' store_id", "cast(id % 7 as string) item_id", f"date_add(date'{START}', cast(id as int)) date", "double(id) sales")
    plan = sparse_features(df, START)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan and plan.count("Exchange hashpartitioning") == 1
