"""Raw tables to the split panel."""

from __future__ import annotations

from pyspark.sql import DataFrame

from larderflow.operators.fill import fill_prices
from larderflow.operators.reshape import fill_events, join_calendar, join_prices, melt_sales, prepare_calendar
from larderflow.operators.splits import with_split
from larderflow.session import written
from larderflow.settings import DataSettings


def merge_tables(long: DataFrame, calendar: DataFrame, prices: DataFrame) -> DataFrame:
    """Long sales with calendar and weekly prices; sales rows without a calendar day stay."""
    return fill_events(join_prices(join_calendar(long, prepare_calendar(calendar)), prices))


def prepare_panel(
    sales: DataFrame, calendar: DataFrame, prices: DataFrame, settings: DataSettings = DataSettings()
) -> DataFrame:
    """Melt, join, fill and split; rows in no split are kept as ``outside``.

    Filling reads the merged table twice (keys and prices for what is carried from stretch to stretch, and the rows), so it is
    written once to the shared folder; write the result too, and build features from the written table.
    """
    merged = written(merge_tables(melt_sales(sales), calendar, prices), "merged")
    return with_split(fill_prices(merged), settings.train_end, settings.val_end, settings.test_end, drop_rest=False)
