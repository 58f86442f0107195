"""Table schemas and column roles of the demand data model."""

from __future__ import annotations

from pyspark.sql import types as T

SERIES = ("store_id", "item_id")
IDENTIFIERS = ("id", "item_id", "dept_id", "cat_id", "store_id", "state_id")
CATEGORIES = ("item_id", "dept_id", "cat_id", "store_id", "state_id")
SNAP = ("snap_CA", "snap_TX", "snap_WI")
EVENTS = ("event_name_1", "event_type_1", "event_name_2", "event_type_2")
NO_EVENT = "None"
DAY_PREFIX = "d_"
# Column in which readers leave what they could not read.
UNREADABLE = "_unreadable"
SPLITS = ("train", "val", "test")
# Rows after the last split or without a date.
OUTSIDE = "outside"

# The three raw files every run needs.
RAW_FILES = {
    "sales": "sales_train_evaluation.csv",
    "calendar": "calendar.csv",
    "prices": "sell_prices.csv",
}

CALENDAR = T.StructType(
    [
        T.StructField("date", T.StringType(), False),
        T.StructField("wm_yr_wk", T.IntegerType(), False),
        T.StructField("weekday", T.StringType(), False),
        T.StructField("wday", T.IntegerType(), False),
        T.StructField("month", T.IntegerType(), False),
        T.StructField("year", T.IntegerType(), False),
        T.StructField("d", T.StringType(), False),
        T.StructField("event_name_1", T.StringType(), True),
        T.StructField("event_type_1", T.StringType(), True),
        T.StructField("event_name_2", T.StringType(), True),
        T.StructField("event_type_2", T.StringType(), True),
        T.StructField("snap_CA", T.IntegerType(), True),
        T.StructField("snap_TX", T.IntegerType(), True),
        T.StructField("snap_WI", T.IntegerType(), True),
    ]
)

PRICES = T.StructType(
    [
        T.StructField("store_id", T.StringType(), False),
        T.StructField("item_id", T.StringType(), False),
        T.StructField("wm_yr_wk", T.IntegerType(), False),
        T.StructField("sell_price", T.DoubleType(), False),
    ]
)

METRIC_HISTORY = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType(), False),
        T.StructField("MAE", T.DoubleType(), True),
        T.StructField("RMSE", T.DoubleType(), True),
        T.StructField("WMAPE", T.DoubleType(), True),
    ]
)

SCORING_REQUEST = T.StructType(
    [
        T.StructField("store_id", T.StringType(), True),
        T.StructField("item_id", T.StringType(), True),
        T.StructField("forecast_horizon", T.IntegerType(), True),
    ]
)


def wide_sales(n_days: int) -> T.StructType:
    """Schema of the wide sales file with ``d_1 .. d_n``."""
    ids = [T.StructField(c, T.StringType(), False) for c in IDENTIFIERS]
    days = [T.StructField(f"{DAY_PREFIX}{i}", T.IntegerType(), True) for i in range(1, n_days + 1)]
    return T.StructType(ids + days)


def day_columns(columns: list[str]) -> list[str]:
    """The daily columns of a wide sales table, in table order."""
    return [c for c in columns if c.startswith(DAY_PREFIX)]
