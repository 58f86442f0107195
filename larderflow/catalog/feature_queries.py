"""Date, event, window, price and category feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from larderflow.catalog import tables
from larderflow.catalog.registry import query, staged_path
from larderflow.catalog.sql import FILLED, PANEL
from larderflow.functions import calendar
from larderflow.operators import encoding, fill, history, pricing, sparse
from larderflow.plans import features as feature_plan
from larderflow.plans import incremental
from larderflow.session import fresh_path
from larderflow.sources import star
from larderflow.sources.bucketed import open_bucketed, series_session, write_bucketed

KEYS = ["store_id", "item_id", "date"]
W = "over (partition by store_id, item_id order by date"


def _rows(n: int, end: str = "current row") -> str:
    return f"{W} rows between {n} preceding and {end})"


def _sales(spark, sf_dir):
    return tables.panel(spark, sf_dir).select(*KEYS, "sales")


def rounded(df, *columns, digits=4):
    return df.withColumns({c: F.round(c, digits) for c in columns})


DATE_SQL = """cast(day(date) as int) "day", cast(isodow(date) - 1 as int) day_of_week, cast(week(date) as int) week_of_year,
    cast(month(date) as int) "month", cast(quarter(date) as int) "quarter", cast(year(date) as int) "year",
    cast(isodow(date) >= 6 as int) is_weekend"""


@query("d01_date_parts", f"{PANEL} select store_id, item_id, date, {DATE_SQL} from panel")
def date_parts(spark, sf_dir):
    """Covers all date components of the feature catalogue."""
    return calendar.with_date_parts(tables.panel(spark, sf_dir).select(*KEYS))


@query("d02_day_of_week", "select event_id, cast(isodow(ts) - 1 as int) day_of_week from events")
def day_of_week(spark, sf_dir):
    rows = star.table(spark, sf_dir, "events")
    return rows.select("event_id", calendar.date_parts("ts")["day_of_week"].alias("day_of_week"))


@query("d03_week_of_year", "select o_orderkey, cast(week(o_orderdate) as int) week_of_year from orders")
def week_of_year(spark, sf_dir):
    rows = star.table(spark, sf_dir, "orders")
    return rows.select("o_orderkey", calendar.date_parts("o_orderdate")["week_of_year"].alias("week_of_year"))


@query(
    "d04_month_quarter_year",
    """select o_orderkey, cast(month(o_orderdate) as int) "month", cast(quarter(o_orderdate) as int) "quarter",
        cast(year(o_orderdate) as int) "year" from orders""",
)
def month_quarter_year(spark, sf_dir):
    parts = calendar.date_parts("o_orderdate")
    return star.table(spark, sf_dir, "orders").select(
        "o_orderkey", *[parts[c].alias(c) for c in ("month", "quarter", "year")]
    )


@query("d05_is_weekend", "select event_id, cast(isodow(ts) >= 6 as int) is_weekend from events")
def is_weekend(spark, sf_dir):
    rows = star.table(spark, sf_dir, "events")
    return rows.select("event_id", calendar.date_parts("ts")["is_weekend"].alias("is_weekend"))


@query(
    "d06_cyclical",
    f"""{PANEL} select store_id, item_id, date,
        {", ".join(f"round({fn}(2 * pi() * {expr} / {n}), 6) + 0.0 {name}_{fn}" for name, expr, n in
                   (("day_of_week", "(isodow(date) - 1)", 7), ("day", "day(date)", 31), ("month", "month(date)", 12))
                   for fn in ("sin", "cos"))} from panel""",
)
def cyclical(spark, sf_dir):
    names = calendar.date_feature_names(True)[7:]
    out = calendar.with_cyclical(calendar.with_date_parts(tables.panel(spark, sf_dir).select(*KEYS)))
    return out.select(*KEYS, *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in names])


@query(
    "d07_date_text",
    """select l_orderkey, l_linenumber, cast(day(l_shipdate) as int) "day", cast(month(l_shipdate) as int) "month"
        from lineitem""",
)
def date_text(spark, sf_dir):
    """Dates arriving as text are parsed by the same functions."""
    text = star.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.date_format("l_shipdate", "yyyy-MM-dd").alias("date")
    )
    parts = calendar.date_parts("date")
    return text.select("l_orderkey", "l_linenumber", parts["day"].alias("day"), parts["month"].alias("month"))


@query("d08_has_event", f"{PANEL} select store_id, item_id, date, cast(event_name_1 is not null as int) has_event from panel")
def has_event(spark, sf_dir):
    return tables.filled(spark, sf_dir).select(*KEYS, calendar.has_event().alias("has_event"))


@query(
    "d09_event_types",
    f"""{PANEL} select store_id, item_id, date,
        {", ".join(f"cast(coalesce(event_type_1, 'None') = '{t}' as int) event_type_{t}" for t in star.EVENT_TYPES)} from panel""",
)
def event_types(spark, sf_dir):
    flags = calendar.event_type_flags(star.EVENT_TYPES)
    return tables.panel(spark, sf_dir).select(*KEYS, *[v.alias(k) for k, v in flags.items()])


@query(
    "d09_default_event_types",
    f"""{PANEL} select store_id, item_id, date, cast(event_name_1 is not null as int) has_event,
        {", ".join(f"cast(coalesce(event_type_1, 'None') = '{t}' as int) event_type_{t}" for t in star.EVENT_TYPES)} from panel""",
)
def default_event_types(spark, sf_dir):
    """One flag for every event type that the data has, without naming them."""
    rows = tables.panel(spark, sf_dir).select(*KEYS, "event_name_1", "event_type_1")
    out = calendar.with_events(rows, calendar.event_vocabulary(rows))
    return out.drop("event_name_1", "event_type_1")


@query("d10_snap", f"{PANEL} select store_id, item_id, date, snap_CA, snap_TX, snap_WI from panel")
def snap(spark, sf_dir):
    out = calendar.with_events(tables.panel(spark, sf_dir), star.EVENT_TYPES)
    return out.select(*KEYS, "snap_CA", "snap_TX", "snap_WI")


CODED = ("item_id", "dept_id", "cat_id", "store_id", "state_id")


def _codes(columns, source):
    joins = " ".join(f"left join c_{c} on {source}.{c} = c_{c}.v" for c in columns)
    ctes = ", ".join(
        f"c_{c} as (select v, cast(row_number() over (order by v) - 1 as int) k from (select distinct {c} v from {source}"
        f" where {c} is not null))"
        for c in columns
    )
    picks = ", ".join(f"coalesce(c_{c}.k, -1) {c}_encoded" for c in columns)
    return ctes, joins, picks


_CTES, _JOINS, _PICKS = _codes(CODED, "panel")


@query("d11_category_codes", f"{PANEL}, {_CTES} select panel.store_id, panel.item_id, date, {_PICKS} from panel {_JOINS}")
def category_codes(spark, sf_dir):
    rows = tables.panel(spark, sf_dir).select(*KEYS, "dept_id", "cat_id", "state_id")
    return encoding.with_codes(rows).select(*KEYS, *[f"{c}_encoded" for c in CODED])


@query(
    "d11_wide_vocabulary_codes",
    """with c as (select v, cast(row_number() over (order by v) - 1 as int) k
        from (select distinct o_custkey::varchar v from orders))
        select o_orderkey, k customer_encoded from orders join c on o_custkey::varchar = v""",
)
def wide_vocabulary_codes(spark, sf_dir):
    """A vocabulary that grows with the data."""
    rows = star.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("customer"))
    return encoding.with_codes(rows, ["customer"]).select("o_orderkey", "customer_encoded")


@query(
    "d11_growing_vocabulary",
    """with v as (select distinct o_custkey::varchar v, min(o_orderdate) over (partition by o_custkey) < date '1995-03-01' early from orders),
        c as (select v, cast((case when early then 0 else (select count(*) from v where early) end)
            + row_number() over (partition by early order by v) - 1 as int) code, cast(not early as int) version from v)
        select o_orderkey, code customer_encoded, version from orders join c on o_custkey::varchar = c.v""",
)
def growing_vocabulary(spark, sf_dir):
    """Codes of the first years' customers stay; later customers get the next ones."""
    rows = star.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.col("o_custkey").cast("string").alias("customer"))
    path = fresh_path(spark, "vocabulary")
    encoding.update_codes(rows.where("o_orderdate < date'1995-03-01'"), path, ["customer"])
    codes = encoding.update_codes(rows, path, ["customer"])
    version = codes.select(F.col("value").alias("customer"), "version")
    return encoding.with_codes(rows, ["customer"], codes).join(version, "customer").select("o_orderkey", "customer_encoded", "version")


# The model features of the documented catalogue, in its order.
CATALOGUE = (
    "day", "day_of_week", "week_of_year", "month", "quarter", "year", "is_weekend", "lag_1", "lag_7", "lag_14", "lag_28", "rolling_mean_7",
    "rolling_std_7", "rolling_mean_14", "rolling_std_14", "rolling_mean_28", "rolling_std_28", "rolling_min_28", "rolling_max_28",
    "price_change_7", "price_relative", "price_rank", "sell_price", "ratio_7_28", "ratio_14_28", "item_id_encoded", "dept_id_encoded",
    "cat_id_encoded", "store_id_encoded", "state_id_encoded", "has_event", "snap_CA", "snap_TX", "snap_WI",
)


@query(
    "d12_feature_catalogue",
    f"""{PANEL}, n as (select count(*) n_rows, count(distinct (store_id, item_id)) n_series from panel)
        select feature, cast(place as int) place, n_rows, case feature {" ".join(f"when 'lag_{k}' then {k} * n_series" for k in (1, 7, 14, 28))}
            when 'price_change_7' then 7 * n_series {" ".join(f"when 'rolling_std_{k}' then n_series" for k in (7, 14, 28))} else 0 end n_missing
        from n, (select unnest({list(CATALOGUE)}) feature, unnest(range({len(CATALOGUE)})) place)""",
)
def feature_catalogue(spark, sf_dir):
    """Each feature of the catalogue, where it stands and how many rows miss it."""
    names = feature_plan.feature_columns()
    rows = tables.features(spark, sf_dir)
    told = [F.struct(F.lit(c).alias("feature"), F.lit(k).alias("place"), F.count_if(F.col(c).isNull()).alias("n_missing")) for k, c in enumerate(names)]
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.array(*told).alias("told")).select("n_rows", F.inline("told"))


@query(
    "w01_lags",
    f"{PANEL} select store_id, item_id, date, {', '.join(f'lag(sales, {k}) {W}) lag_{k}' for k in (1, 7, 14, 28))} from panel",
)
def lags(spark, sf_dir):
    return history.with_lags(_sales(spark, sf_dir), gap_free=True).drop("sales")


SPARSE_ROWS = f"""{PANEL} select store_id, item_id, date,
    {", ".join(f"lag(sales, {k}) {W}) lag_{k}" for k in (1, 7))}, avg(sales) {_rows(27)} rolling_mean_28
    from panel where sales > 0"""


@query("w01_lags_with_gaps", SPARSE_ROWS)
def lags_with_gaps(spark, sf_dir):
    """Steps count rows, whatever the days between them."""
    rows = _sales(spark, sf_dir).where("sales > 0")
    lagged = history.with_lags(rows, periods=(1, 7))
    return history.with_rolling(lagged, windows=((28, ("mean",)),)).drop("sales")


@query(
    "w02_diffs",
    f"{PANEL} select store_id, item_id, date, {', '.join(f'sales - lag(sales, {k}) {W}) diff_{k}' for k in (1, 7))} from panel",
)
def diffs(spark, sf_dir):
    return history.with_diffs(_sales(spark, sf_dir), gap_free=True).drop("sales")


@query(
    "w03_rolling_mean",
    f"{PANEL} select store_id, item_id, date, {', '.join(f'avg(sales) {_rows(n - 1)} rolling_mean_{n}' for n in (7, 14, 28))} from panel",
)
def rolling_mean(spark, sf_dir):
    windows = tuple((n, ("mean",)) for n in (7, 14, 28))
    return history.with_rolling(_sales(spark, sf_dir), windows=windows, gap_free=True).drop("sales")


@query(
    "w03_rolling_mean_past_only",
    f"""{PANEL} select store_id, item_id, date,
        {', '.join(f"avg(sales) {_rows(n, '1 preceding')} rolling_mean_{n}" for n in (7, 28))} from panel""",
)
def rolling_mean_past_only(spark, sf_dir):
    windows = ((7, ("mean",)), (28, ("mean",)))
    rows = _sales(spark, sf_dir)
    return history.with_rolling(rows, windows=windows, gap_free=True, exclude_current=True).drop("sales")


@query(
    "w04_rolling_std",
    f"{PANEL} select store_id, item_id, date, {', '.join(f'round(stddev_samp(sales) {_rows(n - 1)}, 4) rolling_std_{n}' for n in (7, 14, 28))} from panel",
)
def rolling_std(spark, sf_dir):
    windows = tuple((n, ("std",)) for n in (7, 14, 28))
    out = history.with_rolling(_sales(spark, sf_dir), windows=windows, gap_free=True).drop("sales")
    return rounded(out, *[f"rolling_std_{n}" for n in (7, 14, 28)])


@query("w05_rolling_min", f"{PANEL} select store_id, item_id, date, min(sales) {_rows(27)} rolling_min_28 from panel")
def rolling_min(spark, sf_dir):
    return history.with_rolling(_sales(spark, sf_dir), windows=((28, ("min",)),), gap_free=True).drop("sales")


@query("w06_rolling_max", f"{PANEL} select store_id, item_id, date, max(sales) {_rows(27)} rolling_max_28 from panel")
def rolling_max(spark, sf_dir):
    return history.with_rolling(_sales(spark, sf_dir), windows=((28, ("max",)),), gap_free=True).drop("sales")


@query("w07_rolling_sum", f"{PANEL} select store_id, item_id, date, sum(sales) {_rows(6)} rolling_sum_7 from panel")
def rolling_sum(spark, sf_dir):
    return history.with_rolling(_sales(spark, sf_dir), windows=((7, ("sum",)),), gap_free=True).drop("sales")


_UP = f"{W} rows between unbounded preceding and current row)"


@query(
    "w08_expanding",
    f"""{PANEL} select store_id, item_id, date, avg(sales) {_UP} expanding_mean, round(stddev_samp(sales) {_UP}, 4) expanding_std,
        min(sales) {_UP} expanding_min, max(sales) {_UP} expanding_max, sum(sales) {_UP} expanding_sum from panel""",
)
def expanding(spark, sf_dir):
    out = history.with_expanding(_sales(spark, sf_dir), functions=("mean", "std", "min", "max", "sum")).drop("sales")
    return rounded(out, "expanding_std")


@query(
    "w09_ratios",
    f"""{PANEL}, r as (select store_id, item_id, date, {', '.join(f'avg(sales) {_rows(n - 1)} m{n}' for n in (7, 14, 28))} from panel)
        select store_id, item_id, date, round(m7 / (m28 + 1e-8), 4) ratio_7_28, round(m14 / (m28 + 1e-8), 4) ratio_14_28 from r""",
)
def ratios(spark, sf_dir):
    windows = tuple((n, ("mean",)) for n in (7, 14, 28))
    rolled = history.with_rolling(_sales(spark, sf_dir), windows=windows, gap_free=True)
    return rounded(history.with_ratios(rolled).select(*KEYS, "ratio_7_28", "ratio_14_28"), "ratio_7_28", "ratio_14_28")


@query(
    "w10_price_change",
    f"{FILLED} select store_id, item_id, date, sell_price - lag(sell_price, 7) {W}) price_change_7 from filled",
)
def price_change(spark, sf_dir):
    rows = tables.filled(spark, sf_dir).select(*KEYS, "sell_price")
    return history.with_price_change(rows, gap_free=True).drop("sell_price")


@query(
    "w11_price_relative",
    f"""{PANEL} select store_id, item_id, date,
        round(sell_price / (avg(sell_price) over (partition by item_id) + 1e-8), 6) price_relative from panel""",
)
def price_relative(spark, sf_dir):
    rows = tables.panel(spark, sf_dir).select(*KEYS, "sell_price")
    return rounded(pricing.with_relative_price(rows).drop("sell_price"), "price_relative", digits=6)


PRICE_RANK = """case when sell_price is not null then
    (rank() over (partition by item_id order by sell_price nulls last)
     + (count(*) over (partition by item_id, sell_price) - 1) / 2.0) / count(sell_price) over (partition by item_id) end"""


@query("w12_price_rank", f"{PANEL} select store_id, item_id, date, {PRICE_RANK} price_rank from panel")
def price_rank(spark, sf_dir):
    rows = tables.panel(spark, sf_dir).select(*KEYS, "sell_price")
    return pricing.with_price_rank(rows).drop("sell_price")


LAGGED_SQL = f"lagged as (select store_id, item_id, date, lag(sales, 1) {W}) lag_1, lag(sales, 28) {W}) lag_28 from panel)"


def _lagged(spark, sf_dir):
    return history.with_lags(_sales(spark, sf_dir), periods=(1, 28), gap_free=True).drop("sales")


@query("w13_drop_missing", f"{PANEL}, {LAGGED_SQL} select * from lagged where lag_1 is not null and lag_28 is not null")
def drop_missing(spark, sf_dir):
    return fill.fill_features(_lagged(spark, sf_dir), ["lag_1", "lag_28"], "drop")


@query(
    "w14_fill_zero",
    f"{PANEL}, {LAGGED_SQL} select store_id, item_id, date, coalesce(lag_1, 0) lag_1, coalesce(lag_28, 0) lag_28 from lagged",
)
def fill_zero(spark, sf_dir):
    return fill.fill_features(_lagged(spark, sf_dir), ["lag_1", "lag_28"], "fill_zero")


@query(
    "w15_fill_forward",
    f"""{PANEL}, g as (select store_id, item_id, date, case when sales > 0 then sales end lag_1 from panel)
        select store_id, item_id, date, last_value(lag_1 ignore nulls) {_UP} lag_1 from g""",
)
def fill_forward(spark, sf_dir):
    rows = _sales(spark, sf_dir).select(*KEYS, F.when(F.col("sales") > 0, F.col("sales")).alias("lag_1"))
    return fill.fill_features(rows, ["lag_1"], "fill_forward")


@query(
    "w16_fill_median",
    f"""{PANEL} select store_id, item_id, date, coalesce(case when sales > 0 then sales end,
        (select median(sales) from panel where sales > 0)) units,
        coalesce(sell_price, (select median(sell_price) from panel)) sell_price from panel""",
)
def fill_median(spark, sf_dir):
    rows = tables.panel(spark, sf_dir).select(
        *KEYS, F.when(F.col("sales") > 0, F.col("sales")).alias("units"), "sell_price"
    )
    return fill.fill_features(rows, ["units", "sell_price"], "fill_median")


WINDOWS_SQL = ", ".join(
    [f"lag(sales, {k}) {W}) lag_{k}" for k in (1, 7, 14, 28)]
    + [f"sales - lag(sales, {k}) {W}) diff_{k}" for k in (1, 7)]
    + [f"avg(sales) {_rows(n - 1)} rolling_mean_{n}, round(stddev_samp(sales) {_rows(n - 1)}, 4) rolling_std_{n}" for n in (7, 14, 28)]
    + [f"min(sales) {_rows(27)} rolling_min_28, max(sales) {_rows(27)} rolling_max_28"]
    + [f"sell_price - lag(sell_price, 7) {W}) price_change_7"]
)
_F_CTES, _F_JOINS, _F_PICKS = _codes(CODED, "filled")


@query(
    "w18_all_features",
    f"""{FILLED}, {_F_CTES}, x as (select filled.store_id, filled.item_id, date, {DATE_SQL}, sales, sell_price,
        cast(event_name_1 is not null as int) has_event, snap_CA, snap_TX, snap_WI, {WINDOWS_SQL},
        round(sell_price / (avg(sell_price) over (partition by filled.item_id) + 1e-8), 6) price_relative,
        {PRICE_RANK.replace("item_id", "filled.item_id")} price_rank, {_F_PICKS} from filled {_F_JOINS})
        select *, round(rolling_mean_7 / (rolling_mean_28 + 1e-8), 4) ratio_7_28,
        round(rolling_mean_14 / (rolling_mean_28 + 1e-8), 4) ratio_14_28 from x""",
)
def all_features(spark, sf_dir):
    built = feature_plan.create_features(
        tables.filled(spark, sf_dir), include_cyclical=True, include_diff=True, event_types=star.EVENT_TYPES, gap_free=True
    )
    names = [*feature_plan.feature_columns(include_target=True), "diff_1", "diff_7"]
    rough = [f"rolling_std_{n}" for n in (7, 14, 28)] + ["ratio_7_28", "ratio_14_28"]
    return rounded(rounded(built.select(*KEYS, *names), *rough), "price_relative", digits=6)


@query(
    "w18_features_with_gaps",
    f"""{FILLED}, x as (select * from filled where day(date) % 3 <> 0)
        select store_id, item_id, date, lag(sales, 28) {W}) lag_28, round(avg(sales) {_rows(27)}, 6) rolling_mean_28,
        sell_price - lag(sell_price, 7) {W}) price_change_7 from x""",
)
def features_with_gaps(spark, sf_dir):
    """Days are missing and nothing says so: steps still are rows."""
    rows = tables.filled(spark, sf_dir).where(F.dayofmonth("date") % 3 != 0)
    built = feature_plan.create_features(rows, event_types=star.EVENT_TYPES)
    return rounded(built.select(*KEYS, "lag_28", "rolling_mean_28", "price_change_7"), "rolling_mean_28", digits=6)


@query(
    "w17_fill_methods",
    f"""{PANEL} select m "method", count(*) n_rows from panel, (values ('drop'), ('fill_zero')) t(m)
        where m = 'fill_zero' or sell_price is not null group by 1
        union all select 'interpolate', cast(null as bigint)""",
)
def fill_methods(spark, sf_dir):
    """Rows left by each method; an unknown one raises and has none."""
    rows = tables.panel(spark, sf_dir).select(*KEYS, "sell_price")
    parts = []
    for method in ("drop", "fill_zero", "interpolate"):
        try:
            told = fill.fill_features(rows, ["sell_price"], method).agg(F.count(F.lit(1)).alias("n_rows"))
        except ValueError:
            told = rows.limit(1).select(F.lit(None).cast("bigint").alias("n_rows"))
        parts.append(told.select(F.lit(method).alias("method"), "n_rows"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "w19_training_rows",
    f"""{FILLED}, x as (select store_id, item_id, date, split, sales, {", ".join(f"lag(sales, {k}) {W}) lag_{k}" for k in (1, 7, 14, 28))},
        {", ".join(f"round(avg(sales) {_rows(n, '1 preceding')}, 6) rolling_mean_{n}" for n in (7, 14, 28))},
        {", ".join(f"round(stddev_samp(sales) {_rows(n, '1 preceding')}, 4) rolling_std_{n}" for n in (7, 14, 28))},
        min(sales) {_rows(28, '1 preceding')} rolling_min_28, max(sales) {_rows(28, '1 preceding')} rolling_max_28,
        sell_price - lag(sell_price, 7) {W}) price_change_7, sell_price, cast(month(date) as int) "month", snap_CA,
        cast(event_filled <> 'None' as int) has_event from filled)
        select * from x where lag_28 is not null and rolling_std_7 is not null""",
)
def training_rows(spark, sf_dir):
    """Past-only features on the whole panel; validation and test keep all their rows."""
    built = feature_plan.training_features(tables.filled(spark, sf_dir), event_types=star.EVENT_TYPES, gap_free=True)
    rolling = [c for c in built.columns if c.startswith("rolling_")]
    lags = [f"lag_{k}" for k in (1, 7, 14, 28)]
    out = built.select(*KEYS, "split", "sales", *lags, *rolling, "price_change_7", "sell_price", "month", "snap_CA", "has_event")
    means = [c for c in rolling if "mean" in c]
    return rounded(rounded(out, *means, digits=6), *[c for c in rolling if "std" in c])


@query(
    "w18_incremental_days",
    f"""{FILLED}, x as (select store_id, item_id, date, sales, sell_price, {", ".join(f"lag(sales, {k}) {W}) lag_{k}" for k in (1, 7, 14, 28))},
        {", ".join(f"sales - lag(sales, {k}) {W}) diff_{k}" for k in (1, 7))}, sell_price - lag(sell_price, 7) {W}) price_change_7,
        {", ".join(f"round(avg(sales) {_rows(n, '1 preceding')}, 6) rolling_mean_{n}" for n in (7, 14, 28))},
        {", ".join(f"round(stddev_samp(sales) {_rows(n, '1 preceding')}, 6) rolling_std_{n}" for n in (7, 14, 28))},
        min(sales) {_rows(28, '1 preceding')} rolling_min_28, max(sales) {_rows(28, '1 preceding')} rolling_max_28,
        round(avg(sales) {_UP}, 6) expanding_mean, round(stddev_samp(sales) {_UP}, 4) expanding_std from filled)
        select * from x where date >= date '2001-10-30'""",
)
def incremental_days(spark, sf_dir):
    """The last six days in three updates of a state table: one day, two days, three days."""
    rows = tables.filled(spark, sf_dir).select(*KEYS, "sales", "sell_price")
    path = fresh_path(spark, "incremental")
    incremental.start(rows.where("date < date'2001-10-30'"), path)
    for first, last in (("2001-10-30", "2001-10-30"), ("2001-10-31", "2001-11-01"), ("2001-11-02", "2001-11-04")):
        incremental.update(rows.where(F.col("date").between(first, last)), path)
    built = spark.read.parquet(f"{path}/features").drop("ratio_7_28", "ratio_14_28")
    means = [c for c in built.columns if c.startswith(("rolling_mean", "rolling_std")) or c == "expanding_mean"]
    return rounded(rounded(built, *means, digits=6), "expanding_std")


@query(
    "p15_sparse_features",
    f"""{PANEL}, x as (select store_id, item_id, date, sales, {", ".join(f"lag(sales, {k}) {W}) lag_{k}" for k in (1, 7, 14, 28))},
        {", ".join(f"round(avg(sales) {_rows(n - 1)}, 6) rolling_mean_{n}" for n in (7, 14, 28))},
        {", ".join(f"round(stddev_samp(sales) {_rows(n - 1)}, 6) rolling_std_{n}" for n in (7, 14, 28))},
        min(sales) {_rows(27)} rolling_min_28, max(sales) {_rows(27)} rolling_max_28,
        round(avg(sales) {_UP}, 6) expanding_mean, round(stddev_samp(sales) {_UP}, 4) expanding_std, max(sales) {_UP} expanding_max,
        date - date '1995-01-02' - 1 - coalesce(max(case when sales > 0 then date - date '1995-01-02' end) {W}
            rows between unbounded preceding and 1 preceding), -1) zero_run from panel)
        select * replace (cast(zero_run as int) as zero_run) from x where sales > 0 or date in (date '1995-01-09', date '2001-11-04')""",
)
def sparse_rows(spark, sf_dir):
    """Features of the facts, and of two days of every series, without the panel; SQL takes them from the panel."""
    facts = star.daily_sales(spark, sf_dir).select(*KEYS, "sales")
    built = sparse.sparse_features(facts, star.START, expanding=("mean", "std", "max"), at=("1995-01-09", star.END))
    built = built.drop("ratio_7_28", "ratio_14_28")
    means = [c for c in built.columns if c.startswith(("rolling_mean", "rolling_std")) or c == "expanding_mean"]
    return rounded(rounded(built, *means, digits=6), "expanding_std")


@query(
    "w01_bucketed_series",
    f"""{PANEL}, x as (select store_id, item_id, date, lag(sales, 7) {W}) lag_7, round(avg(sales) {_rows(27)}, 6) rolling_mean_28,
        last_value(sell_price ignore nulls) {W} rows between unbounded preceding and current row) sell_price from panel) select * from x""",
)
def bucketed_series(spark, sf_dir):
    """Lag, window and forward fill over a panel stored in buckets of series: each step finds its rows where they are."""
    path = staged_path(
        spark, sf_dir, "bucketed", lambda p: write_bucketed(tables.panel(spark, sf_dir).select(*KEYS, "sales", "sell_price"), _table_of(p), p, 8)
    )
    rows = open_bucketed(series_session(spark), _table_of(path), path, 8)
    out = history.with_rolling(history.with_lags(rows, periods=(7,), gap_free=True), windows=((28, ("mean",)),), gap_free=True)
    out = fill.fill_series(out, backward=False)
    return rounded(out.drop("sales"), "rolling_mean_28", digits=6)


def _table_of(path: str) -> str:
    return path.rpartition("/")[2].replace("-", "_")
