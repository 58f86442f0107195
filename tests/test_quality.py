"""Checks, duplicates, gate and rejects."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from larderflow.operators import quality, reshape
from larderflow.session import fresh_path

WIDE = "id string, item_id string, dept_id string, cat_id string, store_id string, state_id string, d_1 int, d_2 int"
CALENDAR = "date string, wm_yr_wk int, weekday string, wday int, month int, year int, d string, event_name_1 string"
PRICES = "store_id string, item_id string, wm_yr_wk int, sell_price double"


def wide(spark, *rows):
    return spark.createDataFrame(list(rows), WIDE)


GOOD_ROW = ("i1_s1", "i1", "d", "c", "s1", "st", 1, 2)
GOOD_DAY = ("2016-01-01", 11549, "Friday", 7, 1, 2016, "d_1", None)
GOOD_PRICE = ("s1", "i1", 11549, 2.5)


def failing(report):
    return {r.check: r.failed_count for r in report.where("failed_count > 0").collect()}


def test_good_tables_pass_the_gate(spark):
    tables = (
        wide(spark, GOOD_ROW),
        spark.createDataFrame([GOOD_DAY], CALENDAR),
        spark.createDataFrame([GOOD_PRICE], PRICES),
    )
    assert quality.gate(*tables) == tables
    summary = {r.dataset: (r.n_errors, r.n_warnings, r.passed) for r in quality.summarise(quality.check_all(*tables)).collect()}
    assert summary == {"sales": (0, 0, True), "calendar": (0, 1, True), "prices": (0, 0, True)}


def test_sales_issues_are_all_counted(spark):
    bad = wide(spark, GOOD_ROW, GOOD_ROW, (None, None, "d", "c", "s1", "st", -1, 2), (None, "i1", "d", "c", "s1", "st", 3, -4))
    assert failing(quality.check_sales(bad)) == {"null:id": 2, "null:item_id": 1, "negative_sales": 2, "duplicate:id": 2}


def test_schema_issues(spark):
    df = spark.createDataFrame([("x", 1)], "id string, item_id int")
    issues = dict(quality.schema_issues(df, {"id": "string", "item_id": "string", "cat_id": "string"}))
    assert issues == {"column:item_id": "expected string, found int", "column:cat_id": "missing"}
    assert "day_columns" in failing(quality.check_sales(df))


def test_calendar_issues(spark):
    rows = [GOOD_DAY, GOOD_DAY, ("not a date", 11549, "Friday", 8, 13, 2016, "d_3", None)]
    found = failing(quality.check_calendar(spark.createDataFrame(rows, CALENDAR)).where("severity = 'error'"))
    assert found == {"range:wday": 1, "range:month": 1, "date_parse": 1, "duplicate:date": 1}


def test_price_issues(spark):
    rows = [GOOD_PRICE, ("s1", None, 1, 0.0), ("s1", "i1", 1, 1500.0)]
    report = quality.check_prices(spark.createDataFrame(rows, PRICES))
    assert failing(report) == {"null:item_id": 1, "positive:sell_price": 1, "high:sell_price": 1}
    assert report.where("check = 'high:sell_price'").first().severity == "warning"


def test_gate_stops_on_errors(spark):
    with pytest.raises(quality.ValidationFailed, match="prices.positive:sell_price: 1"):
        quality.gate(
            wide(spark, GOOD_ROW),
            spark.createDataFrame([GOOD_DAY], CALENDAR),
            spark.createDataFrame([("s1", "i1", 1, -1.0)], PRICES),
        )


def test_duplicate_rows_keep_every_copy(spark):
    rows = [("hot", 1)] * 500 + [("hot", 2)] * 3 + [("b", 9), (None, 4), (None, 4)]
    found = quality.duplicate_rows(spark.createDataFrame(rows, "id string, x int"), ["id"]).collect()
    assert {(r.id, r.x, r.copies) for r in found} == {("hot", 1, 499), ("hot", 2, 3), (None, 4, 1)}


def test_rejects_name_every_broken_rule(spark):
    df = spark.createDataFrame([(1, -1.0), (2, None), (3, 5.0)], "i int, p double")
    found = quality.rejects(df, {"negative": F.col("p") < 0, "missing": F.col("p").isNull(), "low": F.col("p") < 1})
    assert {r.i: r.reasons for r in found.collect()} == {1: ["negative", "low"], 2: ["missing"]}


def test_date_range(spark):
    df = spark.createDataFrame([("2016-01-01",), ("2016-01-31",), ("x",), (None,)], "date string")
    row = quality.date_range(df).first()
    assert (row.n_bad, str(row.first_date), str(row.last_date), row.span_days) == (1, "2016-01-01", "2016-01-31", 30)


def test_checks_taken_while_writing_equal_the_scanning_ones_in_one_job(spark):
    df = spark.range(1000).selectExpr(
        "if(id % 10 = 0, null, 's') store_id", "'i' item_id", "cast(id as int) wm_yr_wk", "if(id % 7 = 0, null, id - 5.0D) sell_price",
        "if(id % 50 = 0, 'x', '2020-01-' || (id % 28 + 1)) date",
    )
    checks = [*quality.price_checks(df.columns), ("told", "warning", F.count_if(F.col("sell_price") > 900), F.max("sell_price"))]
    prices = quality.watch_checks(df, "prices", checks)
    nulls = quality.watch_nulls(prices.rows)
    missing = reshape.watch_missing_prices(nulls.rows)
    dates = quality.watch_date_range(missing.rows)
    path = fresh_path(spark, "watched")
    spark.sparkContext.setJobGroup("watched", "one write")
    dates.rows.write.parquet(path)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("watched")) == 1
    for watched, scanned in (
        (prices, quality.count_report(df, "prices", checks)), (nulls, quality.null_counts(df)), (missing, reshape.missing_prices(df)),
        (dates, quality.date_range(df)),
    ):
        found = watched.result()
        assert found.columns == scanned.columns and [f.dataType for f in found.schema] == [f.dataType for f in scanned.schema]
        assert found.collect() == scanned.collect()
    assert spark.read.parquet(path).count() == 1000


def test_checks_of_an_empty_table_while_writing(spark):
    df = spark.createDataFrame([], "store_id string, sell_price double")
    watched = quality.watch_checks(df, "prices", quality.price_checks(df.columns))
    watched.rows.write.parquet(fresh_path(spark, "watched"))
    assert watched.result().collect() == quality.count_report(df, "prices", quality.price_checks(df.columns)).collect()
