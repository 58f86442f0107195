"""Exploratory queries and source round trips."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larderflow.catalog import tables
from larderflow.catalog.registry import query
from larderflow.catalog.sql import PANEL, SPARSE, WEEKLY
from larderflow.operators import exploration, quality, ranks, reshape, splits
from larderflow.schemas import IDENTIFIERS, day_columns
from larderflow.session import fresh_path
from larderflow.settings import Settings
from larderflow.sources import files, star


def _train(spark, sf_dir):
    return tables.panel(spark, sf_dir).where("split = 'train'")


def rounded(df, *columns, digits=4):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("a01_shape", f"{PANEL} select count(*) n_rows, 16 n_columns from panel where split = 'train'")
def shape(spark, sf_dir):
    return exploration.shape(_train(spark, sf_dir))


@query(
    "a01_head",
    f"{PANEL} select store_id, item_id, date, sales from panel where split = 'train' order by store_id, item_id, date limit 5",
)
def head(spark, sf_dir):
    return exploration.head(_train(spark, sf_dir), ["store_id", "item_id", "date"]).select(
        "store_id", "item_id", "date", "sales"
    )


@query(
    "a02_info",
    f"""{PANEL} {" union all ".join(f"select {i} \"position\", '{c}' \"column\", '{t}' \"type\", count({c}) non_null from panel"
        for i, (c, t) in enumerate((("store_id", "string"), ("date", "date"), ("sales", "double"), ("sell_price", "double"),
                                    ("event_name_1", "string"), ("snap_CA", "int"))))}""",
)
def info(spark, sf_dir):
    rows = tables.panel(spark, sf_dir)
    return exploration.info(rows.select("store_id", "date", "sales", "sell_price", "event_name_1", "snap_CA"))


def _describe(c):
    return f"""select '{c}' "column", count({c}) "count", round(avg({c}), 4) mean, round(stddev_samp({c}), 4) std, min({c}) min,
        round(quantile_cont({c}, 0.25), 4) p25, round(quantile_cont({c}, 0.5), 4) p50, round(quantile_cont({c}, 0.75), 4) p75,
        max({c}) max from panel where split = 'train'"""


@query("a03_describe", f"{PANEL} {_describe('sales')} union all {_describe('sell_price')}")
def describe(spark, sf_dir):
    stats = exploration.describe(_train(spark, sf_dir), ["sales", "sell_price"])
    return rounded(stats, "mean", "std", "p25", "p50", "p75")


@query(
    "a04_zero_share",
    f"{PANEL} select round(avg(case when sales = 0 then 1.0 else 0.0 end) * 100, 6) zero_pct from panel where split = 'train'",
)
def zero_share(spark, sf_dir):
    return rounded(exploration.zero_share(_train(spark, sf_dir)), "zero_pct", digits=6)


@query(
    "a05_histogram",
    f"""{PANEL}, t as (select sales x from panel where split = 'train'), s as (select min(x) lo, (max(x) - min(x)) / 50 w from t),
        b as (select cast(least(floor((x - lo) / w), 49) as int) bin, count(*) n from t, s group by 1),
        r as (select cast(unnest(generate_series(0, 49)) as int) bin)
        select r.bin, round(lo + r.bin * w, 6) lower, round(lo + (r.bin + 1) * w, 6) upper, coalesce(n, 0) n
        from r cross join s left join b on r.bin = b.bin""",
)
def histogram(spark, sf_dir):
    return rounded(exploration.histogram(_train(spark, sf_dir)), "lower", "upper", digits=6)


@query(
    "a06_box_stats",
    f"""{PANEL}, t as (select sales x from panel where split = 'train'),
        q as (select quantile_cont(x, 0.25) q1, quantile_cont(x, 0.5) q2, quantile_cont(x, 0.75) q3 from t)
        select any_value(q1) q1, any_value(q2) median, any_value(q3) q3,
        min(x) filter (x between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)) whisker_low,
        max(x) filter (x between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)) whisker_high,
        count(*) filter (x not between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)) n_outliers from t, q""",
)
def box_stats(spark, sf_dir):
    return exploration.box_stats(_train(spark, sf_dir))


@query("a07_daily_totals", f"{PANEL} select date, sum(sales) total from panel where split = 'train' group by 1")
def daily_totals(spark, sf_dir):
    return exploration.daily_totals(_train(spark, sf_dir))


@query(
    "a08_top_stores",
    f"""{PANEL} select store_id, sum(sales) sum, round(avg(sales), 6) mean, round(stddev_samp(sales), 4) std from panel
        where split = 'train' group by 1 order by sum desc, store_id limit 5""",
)
def top_stores(spark, sf_dir):
    return exploration.top_stores(_train(spark, sf_dir)).withColumns({"mean": F.round("mean", 6), "std": F.round("std", 4)})


@query("a09_category_totals", f"{PANEL} select cat_id, sum(sales) total from panel where split = 'train' group by 1")
def category_totals(spark, sf_dir):
    return exploration.category_totals(_train(spark, sf_dir))


@query(
    "a10_price_correlation",
    f"""{PANEL}, c as (select round(corr(sell_price, sales), 6) r from panel where split = 'train')
        select 'sell_price' "row", 'sell_price' "column", 1.0::double "value" union all select 'sales', 'sales', 1.0
        union all select 'sell_price', 'sales', r from c union all select 'sales', 'sell_price', r from c""",
)
def price_correlation(spark, sf_dir):
    return rounded(exploration.correlation(_train(spark, sf_dir), "sell_price", "sales"), "value", digits=6)


@query(
    "a11_weekday_means",
    f"""{PANEL} select cast(isodow(date) - 1 as int) day_of_week, round(avg(sales), 6) mean_sales,
        ['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'][isodow(date)] day_name from panel where split = 'train' group by 1, 3""",
)
def weekday_means(spark, sf_dir):
    return rounded(exploration.weekday_means(_train(spark, sf_dir)), "mean_sales", digits=6)


def _raw_folder(spark, sf_dir):
    """The raw CSV layout of the derived tables, written once."""
    folder = fresh_path(spark, "raw")
    for name, df in (
        ("sales_train_evaluation.csv", tables.wide(spark, sf_dir)),
        ("calendar.csv", star.raw_calendar(spark)),
        ("sell_prices.csv", tables.weekly(spark, sf_dir)),
    ):
        df.write.option("header", True).csv(f"{folder}/{name}")
    return folder


@query(
    "s01_read_wide_sales",
    f"{PANEL} select store_id, item_id, d, cast(sales as int) sales from panel",
)
def read_wide_sales(spark, sf_dir):
    folder = _raw_folder(spark, sf_dir)
    sales, _, _ = files.read_raw(spark, folder)
    return reshape.melt_sales(sales).select("store_id", "item_id", "d", F.col("sales").cast("int").alias("sales"))


@query("s01_read_wide_sales_as_text", f"{PANEL} select store_id, item_id, d, cast(sales as int) sales from panel")
def read_wide_sales_as_text(spark, sf_dir):
    folder = _raw_folder(spark, sf_dir)
    long = files.read_sales_long(spark, f"{folder}/sales_train_evaluation.csv")
    return long.select("store_id", "item_id", "d", F.col("sales").cast("int").alias("sales"))


@query(
    "s01_fractional_cells",
    f"{PANEL} select store_id, item_id, d, case when sales <> 1 then sales / 4 end sales from panel",
)
def fractional_cells(spark, sf_dir):
    """Quarter units are read as they are; a cell that is no number has no value."""
    path = fresh_path(spark, "fractional")
    _written_cells(tables.wide(spark, sf_dir)).write.option("header", True).csv(path)
    return reshape.melt_sales(files.read_sales(spark, path)).select("store_id", "item_id", "d", "sales")


def _written_cells(wide):
    """Units in quarters as text, and ``n/a`` for a single unit."""
    days = day_columns(wide.columns)
    cells = F.expr(f"transform(array({', '.join(days)}), x -> if(x = 1, 'n/a', cast(x / 4 as string)))")
    return wide.select(*IDENTIFIERS, F.explode(F.array(cells)).alias("_c")).selectExpr(
        *IDENTIFIERS, *[f"_c[{i}] {c}" for i, c in enumerate(days)]
    )


@query(
    "v05_unreadable_cells",
    f"""{PANEL} select 'unreadable' "check", 'error' severity, count(distinct (store_id, item_id)) failed_count
        from panel where sales = 1""",
)
def unreadable_cells(spark, sf_dir):
    """Lines with a cell that is no number fail the sales check."""
    path = fresh_path(spark, "unreadable")
    _written_cells(tables.wide(spark, sf_dir)).write.option("header", True).csv(path)
    report = quality.check_sales(files.read_sales(spark, path))
    return report.where("check = 'unreadable'").select("check", "severity", "failed_count")


@query("s03_mixed_headers", f"with {WEEKLY.strip()} select * from weekly")
def mixed_headers(spark, sf_dir):
    """Files of one folder with their columns in different orders."""
    path = fresh_path(spark, "prices")
    weekly = tables.weekly(spark, sf_dir)
    odd = F.col("wm_yr_wk") % 2 == 1
    weekly.where(odd).write.option("header", True).option("quoteAll", True).csv(path)
    turned = weekly.where(~odd).select("item_id", "store_id", "sell_price", "wm_yr_wk")
    turned.write.mode("append").option("header", True).csv(path)
    return files.read_prices(spark, path).select("store_id", "item_id", "wm_yr_wk", "sell_price")


@query(
    "s04_dataset_exists",
    f"""with {WEEKLY.strip()} select * from (values ('sales_train_evaluation.csv', false), ('calendar.csv', false),
        ('sell_prices.csv', true)) t(file, present), (select count(*) n_prices from weekly)""",
)
def dataset_exists(spark, sf_dir):
    """Which raw files a folder has that only holds the prices."""
    folder = fresh_path(spark, "partial")
    tables.weekly(spark, sf_dir).write.option("header", True).csv(f"{folder}/sell_prices.csv")
    there = files.check_dataset_exists(spark, folder)
    listed = F.array(*[F.struct(F.lit(n).alias("file"), F.lit(p).alias("present")) for n, p in there.items()])
    read = files.read_prices(spark, f"{folder}/sell_prices.csv")
    return read.agg(F.count(F.lit(1)).alias("n_prices")).select(F.inline(listed), "n_prices")


@query(
    "s10_settings",
    f"""{PANEL} select case when date <= date '1999-12-31' then 'train' when date <= date '2000-06-30' then 'val'
        when date <= date '2000-12-31' then 'test' else 'outside' end split, count(*) n_rows from panel group by 1""",
)
def settings(spark, sf_dir):
    """Split dates from a configuration mapping."""
    ends = {"train_end_date": "1999-12-31", "validation_end_date": "2000-06-30", "test_end_date": "2000-12-31"}
    data = Settings.from_mapping({"data": ends}).data
    rows = splits.with_split(tables.panel(spark, sf_dir), data.train_end, data.val_end, data.test_end, drop_rest=False)
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "s05_processed_full",
    f"""{PANEL} select case when date > date '2001-10-07' or item_id = 'SMALL' then 'outside' else split end split,
        count(*) n_rows, sum(sales) units from panel group by 1""",
)
def processed_full(spark, sf_dir):
    """Rows after the last split or without a date are written to a partition of their own."""
    path = fresh_path(spark, "full")
    rows = tables.panel(spark, sf_dir).drop("split").withColumn("date", F.when(F.col("item_id") != "SMALL", F.col("date")))
    whole = splits.with_split(rows, star.TRAIN_END, star.VAL_END, star.VAL_END, drop_rest=False)
    files.write_splits(whole, path)
    return spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("sales").alias("units"))


@query(
    "s02_read_calendar",
    f"{PANEL} select distinct cast(date as varchar) date, d, wm_yr_wk, event_name_1, snap_CA from panel",
)
def read_calendar(spark, sf_dir):
    path = fresh_path(spark, "calendar")
    days = tables.panel(spark, sf_dir).select("date", "d", "wm_yr_wk").distinct()
    raw = star.raw_calendar(spark).drop("wm_yr_wk").join(days.drop("date"), "d")
    raw.select(*[c for c in files.CALENDAR.names if c in raw.columns]).write.option("header", True).csv(path)
    return files.read_calendar(spark, path).select("date", "d", "wm_yr_wk", "event_name_1", "snap_CA")


@query("s03_read_prices", f"with {WEEKLY.strip()} select * from weekly")
def read_prices(spark, sf_dir):
    path = fresh_path(spark, "prices")
    tables.weekly(spark, sf_dir).write.option("header", True).csv(path)
    return files.read_prices(spark, path).select("store_id", "item_id", "wm_yr_wk", "sell_price")


@query(
    "s05_write_splits",
    f"{PANEL} select split, count(*) n_rows, sum(sales) units, min(date) first_date, max(date) last_date from panel group by 1",
)
def write_splits(spark, sf_dir):
    path = fresh_path(spark, "splits")
    files.write_splits(tables.panel(spark, sf_dir), path)
    return spark.read.parquet(path).groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("sales").alias("units"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )


@query("s06_load_splits", f"{PANEL} select store_id, item_id, date, sales from panel where split = 'test'")
def load_splits(spark, sf_dir):
    path = fresh_path(spark, "splits")
    files.write_splits(tables.panel(spark, sf_dir), path)
    return files.read_splits(spark, path)[2].select("store_id", "item_id", "date", "sales")


@query(
    "a03_sketched_quartiles",
    f"""{PANEL}, x as (select sales v from panel where sales > 0), c as (select sell_price v from panel where sell_price is not null)
        select 'sold' "column", q, count(*) n_values, 0::bigint n_outside from x, (values (0.25), (0.5), (0.75)) t(q) group by 2
        union all select 'sell_price', q, count(*), 0 from c, (values (0.25), (0.5), (0.75)) t(q) group by 2""",
)
def sketched_quartiles(spark, sf_dir):
    """Quartiles merged from one sketch per split; outside means that the exact ranks of a quartile miss its share by over 1 %."""
    rows = tables.panel(spark, sf_dir).select("split", F.when(F.col("sales") > 0, F.col("sales")).alias("sold"), "sell_price")
    names, probs = ["sold", "sell_price"], [0.25, 0.5, 0.75]
    merged = ranks.merge_sketches(ranks.sketches(rows, names, 0.01, ["split"]), names)
    found = {r.column: r.quantiles for r in ranks.sketched_quantiles(merged, names, probs).collect()}
    parts = []
    for name in names:
        for q, value in zip(probs, found[name], strict=True):
            x = F.col(name)
            below, up_to = F.avg((x < value).cast("double")), F.avg((x <= value).cast("double"))
            outside = (below > q + 0.01) | (up_to < q - 0.01)
            told = rows.where(x.isNotNull()).agg(F.count(x).alias("n_values"), outside.cast("bigint").alias("n_outside"))
            parts.append(told.select(F.lit(name).alias("column"), F.lit(q).cast("decimal(3,2)").alias("q"), "n_values", "n_outside"))
    return reduce(DataFrame.unionByName, parts)


@query(
    "s07_feature_table",
    f"""{PANEL}, x as (select split, store_id, item_id, date, sales, lag(sales, 28) over (partition by store_id, item_id order by date) lag_28,
            max(sales) over (partition by store_id, item_id order by date rows between 27 preceding and current row) rolling_max_28 from panel)
        select split, store_id, item_id, count(*) n_rows, min(date) first_date, max(date) last_date, sum(sales) sales, sum(lag_28) lag_28,
            count(lag_28) n_lag_28, sum(rolling_max_28) rolling_max_28 from x group by 1, 2, 3""",
)
def feature_table(spark, sf_dir):
    """Features written by split and read back split by split."""
    path = fresh_path(spark, "feature-splits")
    files.write_splits(tables.features(spark, sf_dir), path)
    parts = [part.withColumn("split", F.lit(name)) for name, part in zip(("train", "val", "test"), files.read_splits(spark, path), strict=True)]
    return reduce(DataFrame.unionByName, parts).groupBy("split", "store_id", "item_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.sum("sales").alias("sales"), F.sum("lag_28").alias("lag_28"), F.count("lag_28").alias("n_lag_28"),
        F.sum("rolling_max_28").alias("rolling_max_28"),
    )


@query("s08_report_csv", f"with {SPARSE.strip()} select store_id, cast(sum(sales) as bigint) total from sparse group by 1")
def report_csv(spark, sf_dir):
    path = fresh_path(spark, "report")
    totals = exploration.total_by(tables.panel(spark, sf_dir), ["store_id"]).withColumn("total", F.col("total").cast("bigint"))
    files.write_report(totals, path)
    return spark.read.schema(totals.schema).option("header", True).csv(path)
