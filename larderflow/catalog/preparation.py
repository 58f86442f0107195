"""Reshape, join, fill and split queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from larderflow.catalog import tables
from larderflow.catalog.registry import query
from larderflow.catalog.sql import CAL, FILLED, FILLED_ONLY, PANEL, PANEL_ONLY, SPARSE, WEEKLY
from larderflow.operators import fill, reshape, splits
from larderflow.plans.prepare import prepare_panel
from larderflow.session import fresh_path
from larderflow.settings import DataSettings
from larderflow.sources import files, star

MERGED = f"with {SPARSE.strip()},{WEEKLY},{CAL},{PANEL_ONLY}"
SETTINGS = DataSettings(train_end=star.TRAIN_END, val_end=star.VAL_END, test_end=star.TEST_END)


def _long(spark, sf_dir):
    return reshape.melt_sales(tables.wide(spark, sf_dir))


@query(
    "p01_melt_sales",
    f"""{PANEL} select item_id || '_' || store_id id, item_id, dept_id, cat_id, store_id, state_id, d,
        cast(sales as int) sales from panel""",
)
def melt_sales(spark, sf_dir):
    return _long(spark, sf_dir)


@query(
    "p02_join_calendar",
    f"""{PANEL} select store_id, item_id, d, cast(sales as int) sales, date, wm_yr_wk,
        coalesce(event_name_1, 'None') event_name_1, snap_CA from panel""",
)
def join_calendar(spark, sf_dir):
    joined = reshape.join_calendar(_long(spark, sf_dir), reshape.prepare_calendar(star.raw_calendar(spark)))
    return joined.select("store_id", "item_id", "d", "sales", "date", "wm_yr_wk", "event_name_1", "snap_CA")


@query(
    "p03_join_prices",
    f"""{MERGED} select p.store_id, p.item_id, p.date, p.wm_yr_wk, w.sell_price from panel p
        left join weekly w on p.store_id = w.store_id and p.item_id = w.item_id and p.wm_yr_wk = w.wm_yr_wk""",
)
def join_prices(spark, sf_dir):
    long = tables.panel(spark, sf_dir).drop("sell_price")
    return reshape.join_prices(long, tables.weekly(spark, sf_dir)).select(
        "store_id", "item_id", "date", "wm_yr_wk", "sell_price"
    )


@query("p04_parse_date", "select o_orderkey, cast(o_orderdate as date) date from orders")
def parse_date(spark, sf_dir):
    text = star.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("date")
    )
    return reshape.prepare_calendar(text)


@query(
    "p05_missing_prices",
    f"""{PANEL} select count(*) n_rows, count(*) - count(sell_price) n_missing,
        round(avg(case when sell_price is null then 1.0 else 0.0 end) * 100, 6) pct_missing from panel""",
)
def missing_prices(spark, sf_dir):
    return reshape.missing_prices(tables.panel(spark, sf_dir)).withColumn("pct_missing", F.round("pct_missing", 6))


@query(
    "p06_series_order",
    f"""{PANEL} select store_id, item_id, date, sales, split, 1::bigint step from panel
        where date not in (date '1995-01-02', date '2001-09-10', date '2001-10-08')
        union all select store_id, item_id, date, sales, split, null from panel
        where date in (date '1995-01-02', date '2001-09-10', date '2001-10-08')""",
)
def series_order(spark, sf_dir):
    """The split tables as written: in the files, each row of a series stands right behind the row of the day before.

    ``step`` is the distance in days to the row before it in its file, null where a file begins a series.
    """
    path = fresh_path(spark, "series-order")
    files.write_splits(tables.panel(spark, sf_dir).select("store_id", "item_id", "date", "sales", "split").coalesce(1), path)
    in_file = Window.partitionBy("_file").orderBy("_row")
    rows = spark.read.parquet(path).select("*", "_metadata.file_path", "_metadata.row_index")
    rows = rows.withColumnsRenamed({"file_path": "_file", "row_index": "_row"})
    before = F.lag(F.struct("store_id", "item_id", "date")).over(in_file)
    same = (before["store_id"] == F.col("store_id")) & (before["item_id"] == F.col("item_id"))
    step = F.when(same, F.datediff("date", before["date"])).cast("bigint")
    return rows.select("store_id", "item_id", "date", "sales", "split", step.alias("step"))


@query(
    "p07_forward_fill",
    f"""{PANEL} select store_id, item_id, date, last_value(sell_price ignore nulls) over (partition by store_id, item_id
        order by date rows between unbounded preceding and current row) sell_price from panel""",
)
def forward_fill(spark, sf_dir):
    rows = tables.panel(spark, sf_dir).select("store_id", "item_id", "date", "sell_price")
    return fill.fill_series(rows, backward=False)


@query("p08_backward_fill", f"{FILLED} select store_id, item_id, date, sell_price from filled")
def backward_fill(spark, sf_dir):
    return fill.fill_series(tables.panel(spark, sf_dir).select("store_id", "item_id", "date", "sell_price"))


@query(
    "p09_item_median_fill",
    f"""with {SPARSE.strip()},{CAL},{PANEL_ONLY.replace("p.sell_price", "case when s.store_id <> 'NATION_3' then p.sell_price end sell_price")},
        {FILLED_ONLY.strip()}, med as (select item_id, median(sell_price) m from filled group by 1)
        select store_id, f.item_id, date, coalesce(sell_price, m) sell_price
        from filled f left join med on f.item_id = med.item_id""",
)
def item_median_fill(spark, sf_dir):
    """One store without any price takes its items' medians from the others."""
    rows = tables.panel(spark, sf_dir).select("store_id", "item_id", "date", "sell_price")
    unpriced = rows.withColumn("sell_price", F.when(F.col("store_id") != "NATION_3", F.col("sell_price")))
    return fill.fill_prices(unpriced)


@query(
    "p10_fill_events",
    f"""{PANEL} select store_id, item_id, date, coalesce(event_name_1, 'None') event_name_1,
        coalesce(event_type_1, 'None') event_type_1 from panel""",
)
def fill_events(spark, sf_dir):
    return reshape.fill_events(
        tables.panel(spark, sf_dir).select("store_id", "item_id", "date", "event_name_1", "event_type_1")
    )


@query(
    "p11_fill_snap",
    f"""{PANEL} select store_id, item_id, date, coalesce(case when sales > 0 then snap_CA end, 0) snap_CA, snap_TX, snap_WI
        from panel""",
)
def fill_snap(spark, sf_dir):
    rows = tables.panel(spark, sf_dir).select(
        "store_id", "item_id", "date", F.when(F.col("sales") > 0, F.col("snap_CA")).alias("snap_CA"), "snap_TX", "snap_WI"
    )
    return reshape.fill_events(rows)


@query("p12_time_split", f"{PANEL} select store_id, item_id, date, split from panel")
def time_split(spark, sf_dir):
    rows = tables.panel(spark, sf_dir).select("store_id", "item_id", "date")
    return splits.with_split(rows, star.TRAIN_END, star.VAL_END, star.TEST_END)


@query(
    "p13_split_leak_check",
    f"""{PANEL}, s as (select min(date) filter (split = 'train') train_first, max(date) filter (split = 'train') train_last,
        min(date) filter (split = 'val') val_first, max(date) filter (split = 'val') val_last,
        min(date) filter (split = 'test') test_first, max(date) filter (split = 'test') test_last from panel)
        select *, train_last < val_first and val_last < test_first and train_last < test_first ordered from s""",
)
def split_leak_check(spark, sf_dir):
    return splits.check_no_leak(tables.panel(spark, sf_dir))


@query(
    "p14_prepare_panel",
    f"""{MERGED}, joined as (
        select p.* exclude (sell_price), w.sell_price from panel p left join weekly w
        on p.store_id = w.store_id and p.item_id = w.item_id and p.wm_yr_wk = w.wm_yr_wk),
        carried as (select *, last_value(sell_price ignore nulls) over (partition by store_id, item_id order by date
              rows between unbounded preceding and current row) fwd,
            first_value(sell_price ignore nulls) over (partition by store_id, item_id order by date
              rows between unbounded preceding and unbounded following) head from joined)
        select item_id || '_' || store_id id, date, cast(sales as int) sales, coalesce(fwd, head) sell_price,
        coalesce(event_name_1, 'None') event_name_1, split from carried""",
)
def prepared(spark, sf_dir):
    out = prepare_panel(
        tables.wide(spark, sf_dir), star.raw_calendar(spark), tables.weekly(spark, sf_dir), SETTINGS
    )
    return out.select("id", "date", "sales", "sell_price", "event_name_1", "split")


@query("p15_densify", f"{PANEL} select store_id, item_id, state_id, date, sales, sell_price from panel")
def densify(spark, sf_dir):
    dense = reshape.densify(star.daily_sales(spark, sf_dir), star.START, star.END, static=star.STATIC)
    return dense.select("store_id", "item_id", "state_id", "date", "sales", "sell_price")
