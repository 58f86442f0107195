"""Demand tables derived from an orders star schema.

A store is a supplier nation, an item is a part type, a day's units are the summed line quantities, and the price is the
day's revenue over its units.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larderflow.operators.reshape import densify
from larderflow.operators.splits import with_split
from larderflow.schemas import IDENTIFIERS

# Day range of the demand calendar and the ends of the three periods.
START, END = "1995-01-02", "2001-11-04"
TRAIN_END, VAL_END, TEST_END = "2001-09-09", "2001-10-07", "2001-11-04"
SIZE_ITEMS = ("SMALL", "MEDIUM", "LARGE")
EVENT_TYPES = ("National", "None", "Religious")
STATIC = ("state_id", "dept_id", "cat_id")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sold_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with store, item, category and day."""
    stores = (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("s_suppkey", F.col("n_name").alias("store_id"), F.col("r_name").alias("state_id"))
    )
    cat = F.when(F.col("p_type").isin(*SIZE_ITEMS), "SIZE").otherwise("TIER")
    items = table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_type").alias("item_id"), cat.alias("dept_id"), cat.alias("cat_id")
    )
    return (
        table(spark, sf_dir, "lineitem")
        .select("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", F.to_date("l_shipdate").alias("date"))
        .join(stores, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(items, F.col("l_partkey") == F.col("p_partkey"))
    )


def price_of(revenue: str, units: str) -> Column:
    """Revenue in whole cents over units."""
    return F.round(F.sum(revenue), 2) / F.sum(units)


def daily_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (store, item, day) with a sale."""
    return (
        sold_lines(spark, sf_dir)
        .groupBy("store_id", "state_id", "item_id", "dept_id", "cat_id", "date")
        .agg(F.sum("l_quantity").alias("sales"), price_of("l_extendedprice", "l_quantity").alias("sell_price"))
    )


def week_key(day: Column) -> Column:
    """The Monday of the week as the integer yyyymmdd."""
    monday = F.date_trunc("week", day)
    return F.year(monday) * 10000 + F.month(monday) * 100 + F.dayofmonth(monday)


def weekly_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (store, item, week) with a sale."""
    return (
        sold_lines(spark, sf_dir)
        .groupBy("store_id", "item_id", week_key(F.col("date")).alias("wm_yr_wk"))
        .agg(price_of("l_extendedprice", "l_quantity").alias("sell_price"))
    )


def calendar_columns(column: str = "date") -> dict[str, Column]:
    """Day key, week key, events and SNAP flags as rules of the date."""
    day, month, dom = F.col(column), F.month(column), F.dayofmonth(column)
    christmas, july4 = (month == 12) & (dom == 25), (month == 7) & (dom == 4)
    new_year = (month == 1) & (dom == 1)
    return {
        "d": F.concat(F.lit("d_"), (F.datediff(day, F.lit(START).cast("date")) + 1).cast("string")),
        "wm_yr_wk": week_key(day),
        "event_name_1": F.when(christmas, "Christmas").when(july4, "Independence").when(new_year, "NewYear"),
        "event_type_1": F.when(christmas, "Religious").when(july4 | new_year, "National"),
        "snap_CA": F.when(dom <= 10, 1).otherwise(0),
        "snap_TX": F.when(dom.between(5, 15), 1).otherwise(0),
        "snap_WI": F.when(dom % 2 == 0, 1).otherwise(0),
    }


def demand_calendar(spark: SparkSession) -> DataFrame:
    """One row per day of the fixed range."""
    days = F.sequence(F.lit(START).cast("date"), F.lit(END).cast("date"), F.expr("interval 1 day"))
    return spark.range(1).select(F.explode(days).alias("date")).withColumns(calendar_columns())


def raw_calendar(spark: SparkSession) -> DataFrame:
    """The calendar in its raw file layout: text dates and nullable events."""
    day = F.col("date")
    return demand_calendar(spark).select(
        F.date_format(day, "yyyy-MM-dd").alias("date"),
        "wm_yr_wk",
        F.date_format(day, "EEEE").alias("weekday"),
        ((F.weekday(day) + 2) % 7 + 1).alias("wday"),
        F.month(day).alias("month"),
        F.year(day).alias("year"),
        "d",
        "event_name_1",
        "event_type_1",
        "snap_CA",
        "snap_TX",
        "snap_WI",
    )


def wide_sales(panel: DataFrame) -> DataFrame:
    """The panel in its raw file layout: one row per series and one integer column per calendar day."""
    n_days = (date.fromisoformat(END) - date.fromisoformat(START)).days + 1
    ids = [F.concat_ws("_", "item_id", "store_id").alias("id"), "item_id", "dept_id", "cat_id", "store_id", "state_id"]
    # A series has one row per calendar day, so each array has exactly n_days entries.
    units = F.sort_array(F.collect_list(F.struct("date", "sales")))["sales"]
    # The explode of a single array keeps the sort from being repeated in every day column.
    rows = panel.groupBy(*ids).agg(units.alias("_all")).withColumn("_units", F.explode(F.array("_all"))).drop("_all")
    return rows.selectExpr(*IDENTIFIERS, *[f"cast(_units[{i}] as int) d_{i + 1}" for i in range(n_days)])


def demand_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap-free daily panel with events, SNAP flags and split; the price is null on days without a sale."""
    dense = densify(daily_sales(spark, sf_dir), START, END, static=STATIC)
    labelled = dense.withColumns(calendar_columns())
    return with_split(labelled, TRAIN_END, VAL_END, TEST_END)
