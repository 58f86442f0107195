"""Series windows against pandas, with one hot series and with gaps."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from larderflow.operators import fill, history, series

SCHEMA = "store_id string, item_id string, date date, sales double, sell_price double"


def make_panel(gaps: bool) -> pd.DataFrame:
    rng = np.random.default_rng(7)
    parts = []
    for item, days in (("hot", 2600), ("a", 40), ("b", 29), ("one", 1)):
        dates = pd.date_range("1996-02-20", periods=days)
        part = pd.DataFrame({"store_id": "s", "item_id": item, "date": dates.date})
        part["sales"] = rng.integers(0, 20, days).astype(float)
        part["sell_price"] = np.where(rng.random(days) < 0.4, np.round(rng.random(days) * 9 + 1, 2), np.nan)
        parts.append(part)
    panel = pd.concat(parts, ignore_index=True)
    if gaps:
        panel = panel[rng.random(len(panel)) < 0.3].reset_index(drop=True)
    return panel.sort_values(["store_id", "item_id", "date"], ignore_index=True)


def to_spark(spark, pdf):
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(), SCHEMA)


def collected(df) -> pd.DataFrame:
    return df.toPandas().sort_values(["store_id", "item_id", "date"], ignore_index=True)


def same(found, expected):
    np.testing.assert_allclose(found.astype(float), expected.astype(float), rtol=1e-9, atol=1e-9)


@pytest.fixture(scope="module", params=[False, True], ids=["daily", "gaps"])
def case(request, spark):
    pdf = make_panel(request.param)
    return pdf, to_spark(spark, pdf), not request.param


def test_lags_and_diffs(case):
    pdf, df, gap_free = case
    found = collected(history.with_diffs(history.with_lags(df, gap_free=gap_free), gap_free=gap_free))
    grouped = pdf.groupby(["store_id", "item_id"])["sales"]
    for k in (1, 7, 14, 28):
        same(found[f"lag_{k}"], grouped.shift(k))
    for k in (1, 7):
        same(found[f"diff_{k}"], grouped.diff(k))


@pytest.mark.parametrize("exclude_current", [False, True])
def test_rolling(case, exclude_current):
    pdf, df, gap_free = case
    windows = ((7, ("mean", "std", "sum")), (28, ("mean", "min", "max")))
    found = collected(history.with_rolling(df, windows=windows, gap_free=gap_free, exclude_current=exclude_current))
    assert len(found) == len(pdf)
    for size, functions in windows:
        for name in functions:
            source = pdf.groupby(["store_id", "item_id"])["sales"]
            expected = source.transform(
                lambda x, size=size, name=name: getattr(
                    (x.shift(1) if exclude_current else x).rolling(size, min_periods=1), name
                )()
            )
            same(found[f"rolling_{name}_{size}"], expected)


@pytest.mark.parametrize("days", [64, 1024])
def test_expanding(case, days):
    pdf, df, _ = case
    functions = ("mean", "std", "min", "max", "sum")
    found = collected(history.with_expanding(df, functions=functions, days=days))
    for name in functions:
        expected = pdf.groupby(["store_id", "item_id"])["sales"].transform(
            lambda x, name=name: getattr(x.expanding(min_periods=1), name)()
        )
        same(found[f"expanding_{name}"], expected)


@pytest.mark.parametrize("days", [16, 1024])
def test_forward_and_backward_fill(case, days):
    pdf, df, _ = case
    forward = pdf.groupby(["store_id", "item_id"])["sell_price"].ffill()
    same(collected(fill.fill_series(df, backward=False, days=days))["sell_price"], forward)
    both = forward.groupby([pdf["store_id"], pdf["item_id"]]).bfill()
    same(collected(fill.fill_series(df, days=days))["sell_price"], both)


def test_row_positions(case):
    pdf, df, _ = case
    found = collected(series.row_positions(df, ["store_id", "item_id"], "date", days=50))
    assert (found["_pos"] == pdf.groupby(["store_id", "item_id"]).cumcount()).all()


def test_hot_series_is_split_over_tasks(spark):
    """No block of the hot series is larger than the block plus its halo."""
    df = to_spark(spark, make_panel(False))
    blocks = series.with_blocks(df, ["store_id", "item_id"], "date", before=28, gap_free=True, block=256)
    sizes = [r["count"] for r in blocks.groupBy("item_id", "_block").count().collect()]
    assert max(sizes) <= 256 + 28
    assert blocks.where("_own").count() == df.count()


def test_last_rows_limits_before_the_shuffle(spark):
    df = to_spark(spark, make_panel(False))
    last = series.last_rows(df, ["store_id", "item_id"], "date", 5)
    assert {r["count"] for r in last.groupBy("item_id").count().collect()} == {5, 1}
    plan = last._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_past_features_do_not_see_later_rows(spark):
    pdf = make_panel(False)
    cut = pdf["date"] <= pd.Timestamp("1996-03-20").date()
    changed = pdf.copy()
    changed.loc[~cut, "sales"] += 1000
    built = [
        collected(history.with_rolling(history.with_lags(to_spark(spark, p), gap_free=True), gap_free=True))[cut]
        for p in (pdf, changed)
    ]
    pd.testing.assert_frame_equal(*built)


def test_unknown_function_is_an_error(spark):
    df = to_spark(spark, make_panel(False))
    with pytest.raises(ValueError, match="unknown function"):
        history.with_rolling(df, windows=((7, ("mode",)),))
    with pytest.raises(ValueError, match="unknown function"):
        history.with_expanding(df, functions=("mode",))


def test_series_windows_share_one_exchange_without_python(spark):
    df = to_spark(spark, make_panel(False))
    w = series.block_window(("store_id", "item_id"), "date")
    columns = history.lag_columns(w, "sales", (1, 28)) | history.diff_columns(w, "sales", (7,))
    columns |= history.price_change_column(w)
    blocks = series.with_blocks(df, ("store_id", "item_id"), "date", before=28, gap_free=True).withColumns(columns)
    built = series.own_rows(history.add_rolling(blocks, w, "sales"))
    plan = built._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1
    assert "SinglePartition" not in plan and "Python" not in plan


def test_fill_features(case):
    pdf, df, _ = case
    two = df.select("store_id", "item_id", "date", F.col("sell_price").alias("lag_1"))
    zero = collected(fill.fill_features(two, ["lag_1"], "fill_zero"))
    same(zero["lag_1"], pdf["sell_price"].fillna(0))
    median = collected(fill.fill_features(two, ["lag_1"], "fill_median"))
    same(median["lag_1"], pdf["sell_price"].fillna(pdf["sell_price"].median()))
    assert fill.fill_features(two, ["lag_1"], "drop").count() == pdf["sell_price"].notna().sum()
    with pytest.raises(ValueError, match="unknown method"):
        fill.fill_features(two, ["lag_1"], "guess")


def test_rows_with_null_keys_or_dates_are_kept(spark):
    df = spark.createDataFrame(
        [("s", None, "2016-01-01", 1.0), ("s", None, "2016-01-02", 2.0), ("s", "a", None, 3.0)],
        "store_id string, item_id string, date string, sales double",
    ).withColumn("date", F.to_date("date"))
    assert history.with_lags(df).count() == 3
    assert history.with_expanding(df).count() == 3
    assert fill.fill_series(df, ["sales"]).count() == 3
