"""Data quality queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larderflow.catalog import tables
from larderflow.catalog.registry import query
from larderflow.catalog.sql import CAL, PANEL, WEEKLY
from larderflow.operators import exploration, quality, reshape
from larderflow.session import fresh_path
from larderflow.sources import star


def _counts(report):
    return report.select("check", "failed_count")


@query(
    "v01_schema_checks",
    f"""{PANEL} select 'column:dept' "check", 'missing' detail, count(*) n_rows from panel
        union all select 'column:sales', 'expected string, found double', count(*) from panel""",
)
def schema_checks(spark, sf_dir):
    """A contract the panel breaks in two places; every issue is reported at once."""
    rows = tables.panel(spark, sf_dir)
    contract = {"store_id": "string", "dept": "string", "sales": "string", "snap_CA": "int"}
    issues = quality.schema_issues(rows, contract)
    listed = F.array(*[F.struct(F.lit(c).alias("check"), F.lit(d).alias("detail")) for c, d in issues])
    return rows.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", F.inline(listed))


@query(
    "v02_range_checks",
    f"""{PANEL} select 'range:wday' "check", count(*) filter (not (isodow(date) between 1 and 5)) failed_count from panel
        union all select 'range:month', count(*) filter (not (month(date) between 1 and 12)) from panel
        union all select 'positive:sales', count(*) filter (sales <= 0) from panel""",
)
def range_checks(spark, sf_dir):
    rows = tables.panel(spark, sf_dir).select(
        (F.weekday("date") + 1).alias("wday"), F.month("date").alias("month"), "sales"
    )
    checks = quality.range_checks({"wday": (1, 5), "month": (1, 12)})
    checks.append(("positive:sales", "error", F.count_if(F.col("sales") <= 0)))
    return _counts(quality.count_report(rows, "panel", checks))


@query(
    "v03_null_keys",
    f"""{PANEL} {" union all ".join(f"select 'null:{c}' \"check\", count(*) - count({c}) failed_count from panel"
        for c in ("store_id", "item_id", "event_name_1", "sell_price"))}""",
)
def null_keys(spark, sf_dir):
    checks = quality.null_checks(["store_id", "item_id", "event_name_1", "sell_price"])
    return _counts(quality.count_report(tables.panel(spark, sf_dir), "panel", checks))


@query("v04_day_columns", f"{PANEL} select count(distinct date) n_day_columns, count(distinct (store_id, item_id)) n_rows from panel")
def count_day_columns(spark, sf_dir):
    wide = tables.wide(spark, sf_dir)
    return wide.agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "n_day_columns", F.lit(len(quality.day_columns(wide.columns))).cast("bigint")
    )


@query(
    "v05_negative_sales",
    f"""{PANEL} select store_id, item_id, min(sales - 30) < 0 has_negative from panel group by 1, 2""",
)
def negative_sales(spark, sf_dir):
    """Units net of a constant return, checked per wide row."""
    wide = tables.wide(spark, sf_dir)
    days = quality.day_columns(wide.columns)
    return wide.selectExpr("store_id", "item_id", f"exists(array({', '.join(days)}), x -> x - 30 < 0) has_negative")


@query(
    "v06_duplicate_ids",
    "select 'duplicate:l_orderkey' \"check\", cast(count(*) - count(distinct l_orderkey) as bigint) failed_count from lineitem",
)
def duplicate_ids(spark, sf_dir):
    return _counts(quality.duplicate_report(star.table(spark, sf_dir, "lineitem"), "lineitem", ["l_orderkey"]))


@query(
    "v06_duplicate_rows",
    """with r as (select o_custkey, o_orderstatus, o_orderpriority, count(*) copies,
        row_number() over (partition by o_custkey order by o_orderstatus, o_orderpriority) rn
        from orders group by 1, 2, 3)
        select o_custkey, o_orderstatus, o_orderpriority, copies - case when rn = 1 then 1 else 0 end copies from r
        where copies - case when rn = 1 then 1 else 0 end > 0""",
)
def duplicate_rows(spark, sf_dir):
    rows = star.table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority")
    return quality.duplicate_rows(rows, ["o_custkey"])


@query(
    "v07_duplicate_dates",
    "select 'duplicate:date' \"check\", cast(count(*) - count(distinct cast(o_orderdate as date)) as bigint) failed_count from orders",
)
def duplicate_dates(spark, sf_dir):
    days = star.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date"))
    return _counts(quality.duplicate_report(days, "orders", ["date"]))


@query(
    "v08_date_range",
    """select count(*) filter (try_cast(t as date) is null) n_bad, min(try_cast(t as date)) first_date,
        max(try_cast(t as date)) last_date, cast(max(try_cast(t as date)) - min(try_cast(t as date)) as int) span_days
        from (select case when l_returnflag = 'R' then 'returned' else strftime(l_shipdate, '%Y-%m-%d') end t from lineitem)""",
)
def date_range(spark, sf_dir):
    text = star.table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_returnflag") == "R", "returned").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("date")
    )
    return quality.date_range(text)


@query(
    "v09_null_counts",
    f"""{PANEL} {" union all ".join(f"select '{c}' \"column\", count(*) - count({c}) n_null from panel"
        for c in ("store_id", "item_id", "state_id", "dept_id", "cat_id", "date", "sales", "sell_price", "d", "wm_yr_wk",
                  "event_name_1", "event_type_1", "snap_CA", "snap_TX", "snap_WI", "split"))}""",
)
def null_counts(spark, sf_dir):
    return quality.null_counts(tables.panel(spark, sf_dir))


@query(
    "v10_price_nulls",
    f"""{PANEL} {" union all ".join(f"select 'null:{c}' \"check\", 'error' severity, count(*) - count({c}) failed_count from panel"
        for c in ("store_id", "item_id", "wm_yr_wk", "sell_price"))}
        union all select 'positive:sell_price', 'error', count(*) filter (sell_price <= 0) from panel
        union all select 'high:sell_price', 'warning', count(*) filter (sell_price > 1000) from panel""",
)
def price_nulls(spark, sf_dir):
    prices = tables.panel(spark, sf_dir).select("store_id", "item_id", "wm_yr_wk", "sell_price")
    return quality.check_prices(prices).select("check", "severity", "failed_count")


@query(
    "v10_checks_while_writing",
    f"""{PANEL}, n as (select count(*) n, count(*) - count(sell_price) gone, count(*) filter (sell_price <= 0) low,
            count(*) filter (sell_price > 1000) high, min(date) a, max(date) b, count(*) - count(event_name_1) no_event from panel)
        select 'null:sell_price' measure, cast(gone as double) told from n union all select 'null:item_id', 0.0 from n
        union all select 'null:store_id', 0.0 from n union all select 'null:wm_yr_wk', 0.0 from n
        union all select 'positive:sell_price', cast(low as double) from n union all select 'high:sell_price', cast(high as double) from n
        union all select 'n_null event_name_1', cast(no_event as double) from n
        union all select 'pct_missing', round(gone * 100.0 / n, 6) from n union all select 'span_days', cast(b - a as double) from n
        union all select 'n_bad', 0.0 from n""",
)
def checks_while_writing(spark, sf_dir):
    """Price checks, nulls, missing prices and the range of dates, all taken by the one job that writes the panel."""
    prices = quality.watch_checks(tables.panel(spark, sf_dir), "prices", quality.price_checks(["store_id", "item_id", "wm_yr_wk", "sell_price"]))
    nulls = quality.watch_nulls(prices.rows, ["event_name_1"])
    missing = reshape.watch_missing_prices(nulls.rows)
    dates = quality.watch_date_range(missing.rows)
    dates.rows.write.parquet(fresh_path(spark, "watched"))
    told = F.col("failed_count").cast("double")
    parts = [
        prices.result().select(F.col("check").alias("measure"), told.alias("told")),
        nulls.result().select(F.concat(F.lit("n_null "), "column").alias("measure"), F.col("n_null").cast("double").alias("told")),
        missing.result().select(F.lit("pct_missing").alias("measure"), F.round("pct_missing", 6).alias("told")),
        dates.result().select(F.lit("span_days").alias("measure"), F.col("span_days").cast("double").alias("told")),
        dates.result().select(F.lit("n_bad").alias("measure"), F.col("n_bad").cast("double").alias("told")),
    ]
    return reduce(DataFrame.unionByName, parts)


PRICE_STATS = """select 'sell_price' "column", count(sell_price) "count", round(avg(sell_price), 4) mean,
        round(stddev_samp(sell_price), 4) std, min(sell_price) min, round(quantile_cont(sell_price, 0.25), 4) p25,
        round(quantile_cont(sell_price, 0.5), 4) p50, round(quantile_cont(sell_price, 0.75), 4) p75, max(sell_price) max"""


def rounded(df, *columns, digits=4):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("v11_price_distribution", f"with {WEEKLY.strip()} {PRICE_STATS} from weekly")
def price_distribution(spark, sf_dir):
    stats = exploration.describe(tables.weekly(spark, sf_dir), ["sell_price"])
    return rounded(stats, "mean", "std", "p25", "p50", "p75")


@query("v12_high_prices", f"with {WEEKLY.strip()} select 'high:sell_price' \"check\", count(*) failed_count from weekly where sell_price > 1000")
def high_prices(spark, sf_dir):
    return _counts(quality.check_prices(tables.weekly(spark, sf_dir))).where("check = 'high:sell_price'")


@query(
    "v13_validate_all",
    f"""with {WEEKLY.strip()},{CAL} select 'sales' dataset, 0::bigint n_errors, 0::bigint n_warnings, true passed
        union all select 'calendar', 0, (select count(*) filter (event_name_1 is null) > 0 from cal)::int
            + (select count(*) filter (event_type_1 is null) > 0 from cal)::int, true
        union all select 'prices', (select count(*) filter (sell_price <= 0) > 0 from weekly)::int,
            (select count(*) filter (sell_price > 1000) > 0 from weekly)::int,
            (select count(*) filter (sell_price <= 0) = 0 from weekly)""",
)
def validate_all(spark, sf_dir):
    report = quality.check_all(tables.wide(spark, sf_dir), star.raw_calendar(spark), tables.weekly(spark, sf_dir))
    return quality.summarise(report)


@query(
    "v14_rejects",
    f"""{PANEL} select store_id, item_id, date, case when sell_price is null then 1 else 0 end
        + case when sales > 30 then 1 else 0 end n_reasons from panel where sell_price is null or sales > 30""",
)
def reject_rows(spark, sf_dir):
    """Rows a quarantine sink would take, after the gate has passed the raw tables."""
    sales, calendar, prices = tables.wide(spark, sf_dir), star.raw_calendar(spark), tables.weekly(spark, sf_dir)
    quality.gate(sales, calendar, prices)
    bad = quality.rejects(
        tables.panel(spark, sf_dir), {"no price": F.col("sell_price").isNull(), "many units": F.col("sales") > 30}
    )
    return bad.select("store_id", "item_id", "date", F.size("reasons").alias("n_reasons"))
