"""Melting, joins, densifying, splits and the training tables."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from larderflow.operators import reshape, splits
from larderflow.plans.features import create_features, feature_columns, training_features
from larderflow.plans.prepare import merge_tables, prepare_panel
from larderflow.settings import DataSettings

WIDE = "id string, item_id string, dept_id string, cat_id string, store_id string, state_id string"


def small_wide(spark, n_days=3, first=1):
    days = ", ".join(f"d_{first + i} int" for i in range(n_days))
    rows = [(f"{i}_s", i, "dept", "cat", "s", "st", *[10 * k + d for d in range(n_days)]) for k, i in enumerate("ab")]
    return spark.createDataFrame(rows, f"{WIDE}, {days}")


def small_calendar(spark, n_days=3):
    start = dt.date(2016, 1, 1)
    rows = []
    for i in range(n_days):
        day = start + dt.timedelta(days=i)
        rows.append((str(day), 1 + i // 7, "x", 1, day.month, day.year, f"d_{i + 1}", "Party" if i == 1 else None, None, None))
    return spark.createDataFrame(
        rows,
        "date string, wm_yr_wk int, weekday string, wday int, month int, year int, d string, event_name_1 string, "
        "event_type_1 string, snap_CA int",
    )


@pytest.mark.parametrize("first", [1, 5])
def test_melt_keeps_every_cell(spark, first):
    long = reshape.melt_sales(small_wide(spark, 3, first))
    found = {(r.item_id, r.d): r.sales for r in long.collect()}
    assert found == {(i, f"d_{first + d}"): 10 * k + d for k, i in enumerate("ab") for d in range(3)}


def test_melt_without_days(spark):
    with pytest.raises(ValueError, match="no d_"):
        reshape.melt_sales(spark.createDataFrame([("x",)], "id string"))


def test_merge_keeps_sales_without_calendar_or_price(spark):
    prices = spark.createDataFrame([("s", "a", 1, 2.0)], "store_id string, item_id string, wm_yr_wk int, sell_price double")
    merged = merge_tables(reshape.melt_sales(small_wide(spark, 3)), small_calendar(spark, 2), prices)
    found = {(r.item_id, r.d): (r.sell_price, r.event_name_1, r.snap_CA) for r in merged.collect()}
    assert len(found) == 6
    assert found[("a", "d_2")] == (2.0, "Party", 0)
    assert found[("b", "d_1")] == (None, "None", 0)
    assert found[("a", "d_3")] == (None, "None", 0)


def test_prepare_panel_fills_and_splits(spark):
    prices = spark.createDataFrame([("s", "a", 2, 4.0)], "store_id string, item_id string, wm_yr_wk int, sell_price double")
    settings = DataSettings(train_end="2016-01-07", val_end="2016-01-09", test_end="2016-01-10")
    panel = prepare_panel(small_wide(spark, 12), small_calendar(spark, 12), prices, settings)
    rows = panel.collect()
    assert {r.sell_price for r in rows if r.item_id == "a"} == {4.0}
    assert {r.sell_price for r in rows if r.item_id == "b"} == {None}
    assert {r["split"]: r["count"] for r in panel.groupBy("split").count().collect()} == {"train": 14, "val": 4, "test": 2, "outside": 4}


def test_densify_uses_no_cross_join(spark):
    facts = spark.createDataFrame(
        [("s", "a", dt.date(2016, 1, 1), 1.0), ("s", "b", dt.date(2016, 1, 3), 2.0)],
        "store_id string, item_id string, date date, sales double",
    )
    dense = reshape.densify(facts)
    assert {(r.item_id, r.date.day): r.sales for r in dense.collect()} == {
        ("a", 1): 1.0, ("a", 2): 0.0, ("a", 3): 0.0, ("b", 1): 0.0, ("b", 2): 0.0, ("b", 3): 2.0,
    }
    plan = dense._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def days_frame(spark, n, split_last=28):
    start = dt.date(2016, 1, 1)
    rows = [("s", "a", "d", "c", "st", start + dt.timedelta(days=i), float(i % 7), 2.0) for i in range(n)]
    df = spark.createDataFrame(
        rows, "store_id string, item_id string, dept_id string, cat_id string, state_id string, date date, sales double, sell_price double"
    )
    ends = [start + dt.timedelta(days=n - 1 - split_last * k) for k in (2, 1, 0)]
    return splits.with_split(df, *map(str, ends))


def test_splits_are_disjoint_complete_and_checked(spark):
    df = days_frame(spark, 100)
    assert {r["split"]: r.n_rows for r in splits.split_report(df).collect()} == {"train": 44, "val": 28, "test": 28}
    assert splits.assert_no_leak(df).count() == 100
    mixed = df.withColumn("split", F.when(F.col("split") == "val", "train").otherwise("val"))
    with pytest.raises(ValueError, match="overlap"):
        splits.assert_no_leak(mixed)


def test_rows_after_the_last_period_are_dropped(spark):
    df = days_frame(spark, 10, 2).drop("split")
    assert splits.with_split(df, "2016-01-02", "2016-01-04", "2016-01-06").count() == 6


def test_training_features_see_history_across_splits(spark):
    df = days_frame(spark, 100)
    whole = training_features(df).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in whole} == {"train": 16, "val": 28, "test": 28}
    alone = training_features(df, per_split=True).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in alone} == {"train": 16}


def test_feature_catalogue(spark):
    assert len(feature_columns()) == 34
    assert feature_columns(include_target=True, include_identifiers=True)[-5:] == ["sales", "id", "item_id", "store_id", "date"]
    calendar = {"event_name_1": "None", "event_type_1": "None"}
    df = days_frame(spark, 40).withColumns({c: F.lit(v) for c, v in calendar.items()})
    df = df.withColumns({c: F.lit(0) for c in ("snap_CA", "snap_TX", "snap_WI")})
    assert set(feature_columns()) <= set(create_features(df).columns)


def test_features_are_the_same_with_and_without_the_gap_free_promise(spark):
    df = days_frame(spark, 60)
    names = [c for c in create_features(df).columns]
    a = create_features(df, gap_free=True).select(*names).orderBy("date").collect()
    b = create_features(df, gap_free=False).select(*names).orderBy("date").collect()
    assert a == b
