"""CSV and parquet round trips, settings, calendar features."""

from __future__ import annotations

import dataclasses
import datetime as dt
import math
import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from larderflow.functions import calendar
from larderflow.operators import quality, reshape
from larderflow.session import discard, fresh_path, shared_folder, written
from larderflow.settings import KEYS, Settings
from larderflow.sources import files

SALES = """id,item_id,dept_id,cat_id,store_id,state_id,d_1,d_2
a_s,a,d,c,s,st,3,0
b_s,b,d,c,s,st,,7
"""
CALENDAR = """date,wm_yr_wk,weekday,wday,month,year,d,event_name_1,event_type_1,event_name_2,event_type_2,snap_CA,snap_TX,snap_WI
2016-01-01,1,Friday,7,1,2016,d_1,NewYear,National,,,1,0,0
2016-01-02,1,Saturday,1,1,2016,d_2,,,,,1,0,1
"""
PRICES = """store_id,item_id,wm_yr_wk,sell_price
s,a,1,2.5
s,b,1,NaN
"""


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    for name, text in (("sales_train_evaluation.csv", SALES), ("calendar.csv", CALENDAR), ("sell_prices.csv", PRICES)):
        (folder / name).write_text(text)
    return str(folder)


def test_read_raw(spark, raw):
    sales, cal, prices = files.read_raw(spark, raw)
    assert dict(sales.dtypes)["d_2"] == "double" and dict(cal.dtypes)["wday"] == "int"
    assert [r.event_name_1 for r in cal.orderBy("d").collect()] == ["NewYear", None]
    assert {r.item_id: r.sell_price for r in prices.collect()} == {"a": 2.5, "b": None}


def test_text_reader_equals_typed_reader(spark, raw):
    typed = reshape.melt_sales(files.read_sales(spark, f"{raw}/sales_train_evaluation.csv"))
    text = files.read_sales_long(spark, f"{raw}/sales_train_evaluation.csv").drop("_unreadable")
    assert sorted(map(str, typed.collect())) == sorted(map(str, text.collect()))
    assert text.count() == 4


def test_cells_that_are_no_numbers(spark, tmp_path):
    path = tmp_path / "sales.csv"
    path.write_text('"id",item_id,dept_id,cat_id,store_id,state_id,d_1,d_2\na,i,d,c,s,t,1.0,2.5\nb,i,d,c,s,t,abc,-1\n')
    sales = files.read_sales(spark, str(path))
    assert sales.columns[0] == "id"
    assert sorted((r.id, r.d_1, r.d_2) for r in sales.collect()) == [("a", 1.0, 2.5), ("b", None, -1.0)]
    report = {r.check: r for r in quality.check_sales(sales).collect() if r.failed_count}
    assert set(report) == {"unreadable", "negative_sales"}
    assert report["unreadable"].detail == "b,i,d,c,s,t,abc,-1" and report["negative_sales"].detail == "d_2"
    long = files.read_sales_long(spark, str(path))
    assert sorted((r.id, r.d, r.sales, r._unreadable) for r in long.collect()) == [
        ("a", "d_1", 1.0, None), ("a", "d_2", 2.5, None), ("b", "d_1", None, "abc"), ("b", "d_2", -1.0, None)
    ]


def test_files_with_other_column_orders(spark, tmp_path):
    (tmp_path / "a.csv").write_text("store_id,item_id,wm_yr_wk,sell_price\ns,a,1,2.5\n")
    (tmp_path / "b.csv").write_text("sell_price,item_id,store_id,wm_yr_wk\n3.5,b,t,2\n")
    prices = files.read_prices(spark, str(tmp_path))
    assert sorted((r.store_id, r.item_id, r.wm_yr_wk, r.sell_price) for r in prices.collect()) == [("s", "a", 1, 2.5), ("t", "b", 2, 3.5)]
    (tmp_path / "c.csv").write_text("sell_price,item_id,shop,wm_yr_wk\n3.5,b,t,2\n")
    with pytest.raises(ValueError, match="shop"):
        files.read_prices(spark, str(tmp_path))


def test_shared_folder_must_be_named(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    nameless = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: default))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(nameless)


def test_missing_files_are_named(spark, tmp_path):
    assert set(files.check_dataset_exists(spark, str(tmp_path)).values()) == {False}
    with pytest.raises(FileNotFoundError, match="calendar.csv"):
        files.read_raw(spark, str(tmp_path))


def test_splits_are_pruned(spark):
    df = spark.createDataFrame(
        [("s", "a", dt.date(2016, 1, i + 1), s) for i, s in enumerate(("train", "train", "val", "test"))],
        "store_id string, item_id string, date date, split string",
    )
    path = fresh_path(spark, "splits")
    files.write_splits(df, path)
    train, val, test = files.read_splits(spark, path)
    assert (train.count(), val.count(), test.count()) == (2, 1, 1)
    plan = test._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def test_report_csv(spark):
    path = fresh_path(spark, "report")
    files.write_report(spark.createDataFrame([("m", 1.5)], "model string, MAE double"), path)
    assert spark.read.option("header", True).csv(path).first().asDict() == {"model": "m", "MAE": "1.5"}


def test_checkpoint_folder_comes_from_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert fresh_path(spark, "x") != fresh_path(spark, "x")


def test_settings():
    assert Settings.from_mapping() == Settings()
    changed = Settings.from_mapping(
        {
            "data": {"train_end_date": "2015-01-01"},
            "features": {"lag_periods": [2], "rolling_windows": [{"window": 3, "functions": ["sum"]}]},
            "models": {"forecast_horizon": 14, "xgboost": {"n_estimators": 5}, "tft": {"max_encoder_length": 10}},
            "monitoring": {"drift_threshold": 0.3},
            "mlops": {"retrain_interval_days": 7},
        }
    )
    assert changed.data.train_end == "2015-01-01" and changed.data.val_end == "2016-04-24"
    assert changed.features.lag_periods == (2,) and changed.features.rolling_windows == ((3, ("sum",)),)
    assert changed.forecast.horizon == 14 and changed.forecast.min_encoder_length == 5
    assert changed.boosting.n_estimators == 5 and changed.monitoring.drift_threshold == 0.3
    assert changed.monitoring.retrain_interval_days == 7


def test_every_setting_can_be_given_and_slips_raise():
    tree = {
        "features": {"diff_periods": [3], "date_features": ["day"]},
        "models": {"season_length": 30, "averages": [5, 9], "max_horizon": 14, "lstm": {"epochs": 5}, "tft": {"quantiles": [0.2, 0.8], "dropout": 0.1},
                   "xgboost": {"validation_tol": 0.5, "colsample_bytree": 0.4, "random_state": 7}},
        "evaluation": {"baseline_model": "naive", "metrics": ["mae"]},
        "mlops": {"min_improvement_threshold": 0.5},
    }
    found = Settings.from_mapping(tree)
    assert found.features.diff_periods == (3,) and found.baseline_model == "naive" and found.monitoring.min_improvement == 0.5
    assert (found.forecast.season_length, found.forecast.averages, found.forecast.max_horizon, found.forecast.quantiles) == (30, (5, 9), 14, (0.2, 0.8))
    assert (found.boosting.validation_tol, found.boosting.colsample, found.boosting.seed) == (0.5, 0.4, 7)
    for part, fields in (("data", found.data), ("features", found.features), ("boosting", found.boosting), ("forecast", found.forecast), ("monitoring", found.monitoring)):
        assert {f.name for f in dataclasses.fields(fields)} == {v.partition(".")[2] for v in KEYS.values() if v.startswith(f"{part}.")}
    with pytest.raises(ValueError, match="models.xgboost.n_estimator, monitoring.drift"):
        Settings.from_mapping({"models": {"xgboost": {"n_estimator": 5}}, "monitoring": {"drift": 1}})


def test_lines_with_too_many_or_too_few_cells(spark, tmp_path):
    path = tmp_path / "sales.csv"
    path.write_text('id,item_id,d_1,d_2\na,x,1,2\nb,"y,z",3,4\nc,x,5\n')
    found = {(r.id, r.d, r.sales, r._unreadable) for r in files.read_sales_long(spark, str(path)).collect()}
    assert found == {("a", "d_1", 1.0, None), ("a", "d_2", 2.0, None), (None, None, None, 'b,"y,z",3,4'), (None, None, None, "c,x,5")}


def test_settings_from_yaml(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("models:\n  forecast_horizon: 3\n")
    assert Settings.from_yaml(str(tmp_path / "c.yaml")).forecast.horizon == 3


@pytest.mark.parametrize("day", ["2015-12-31", "2016-01-03", "2016-02-29", "2018-12-31"])
def test_date_parts(spark, day):
    parsed = dt.date.fromisoformat(day)
    df = calendar.with_cyclical(calendar.with_date_parts(spark.createDataFrame([(day,)], "date string")))
    row = df.first()
    assert (row.day, row.day_of_week, row.week_of_year) == (parsed.day, parsed.weekday(), parsed.isocalendar().week)
    assert (row.quarter, row.is_weekend) == ((parsed.month + 2) // 3, int(parsed.weekday() >= 5))
    assert row.day_sin == pytest.approx(math.sin(2 * math.pi * parsed.day / 31))
    assert row.month_cos == pytest.approx(math.cos(2 * math.pi * parsed.month / 12))


def test_events(spark):
    df = spark.createDataFrame([("NewYear", "National"), (None, None), ("None", "None")], "event_name_1 string, event_type_1 string")
    vocabulary = calendar.event_vocabulary(df)
    assert vocabulary == ["National", "None"]
    rows = calendar.with_events(df, vocabulary).collect()
    assert [r.has_event for r in rows] == [1, 0, 0]
    assert [r.event_type_None for r in rows] == [0, 1, 1]
    assert calendar.with_events(df.select(F.lit(1).alias("x")), vocabulary).columns == ["x"]


def test_discarding_written_tables(spark, tmp_path):
    table = written(spark.range(10).toDF("x"), "gone")
    folder = table.inputFiles()[0].rpartition("/")[0].removeprefix("file://")
    assert os.path.isdir(folder)
    discard(table.select((F.col("x") + 1).alias("y")))
    assert not os.path.exists(folder)
    spark.range(3).write.parquet(f"{tmp_path}/own")
    with pytest.raises(ValueError, match="not a table of the shared folder"):
        discard(spark.read.parquet(f"{tmp_path}/own"))
    assert os.path.isdir(f"{tmp_path}/own")
