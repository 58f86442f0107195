"""Wide to long, joins with calendar and prices, densifying."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larderflow.operators.quality import Watched
from larderflow.schemas import DAY_PREFIX, EVENTS, IDENTIFIERS, NO_EVENT, SERIES, SNAP, UNREADABLE, day_columns


def melt_sales(wide: DataFrame, ids: Sequence[str] = IDENTIFIERS) -> DataFrame:
    """One row per (series, day column): ``ids, d, sales``.

    A single array column and ``posexplode`` keep the plan small at thousands of day columns.
    """
    days = day_columns(wide.columns)
    if not days:
        raise ValueError(f"no {DAY_PREFIX}* columns to melt")
    columns = set(wide.columns)
    kept = [c for c in ids if c in columns]
    day_array = F.expr(f"array({', '.join(f'`{c}`' for c in days)})")
    exploded = wide.select(*kept, F.posexplode(day_array).alias("_pos", "sales"))
    return exploded.select(*kept, day_name(days, F.col("_pos")).alias("d"), "sales")


def day_name(days: Sequence[str], position: Column) -> Column:
    """Name of the day column at a 0-based position."""
    if list(days) == [f"{DAY_PREFIX}{i}" for i in range(1, len(days) + 1)]:
        return F.concat(F.lit(DAY_PREFIX), (position + 1).cast("string"))
    return F.element_at(F.array(*[F.lit(c) for c in days]), position + 1)


def prepare_calendar(calendar: DataFrame) -> DataFrame:
    """Parse the date, fill absent events with ``'None'`` and absent SNAP flags with 0."""
    return fill_events(calendar.drop(UNREADABLE).withColumn("date", F.to_date("date")))


def join_calendar(long: DataFrame, calendar: DataFrame, on: str = "d") -> DataFrame:
    """Left join on the day key; the calendar is one row per day, so its measured size decides the broadcast."""
    return long.join(calendar.drop(UNREADABLE), on, "left")


def join_prices(
    df: DataFrame, prices: DataFrame, keys: Sequence[str] = (*SERIES, "wm_yr_wk")
) -> DataFrame:
    """Left join of weekly prices on (store, item, week)."""
    return df.join(prices.drop(UNREADABLE), list(keys), "left")


def event_columns(columns: Sequence[str]) -> list[str]:
    return [c for c in columns if "event" in c.lower()]


def fill_events(df: DataFrame) -> DataFrame:
    """Null event columns become ``'None'``, null ``snap_*`` columns become 0."""
    events = [c for c in event_columns(df.columns) if dict(df.dtypes)[c] == "string"]
    snaps = [c for c in df.columns if c.startswith("snap_")]
    if events:
        df = df.na.fill(NO_EVENT, events)
    return df.na.fill(0, snaps) if snaps else df


def missing_prices(df: DataFrame, price: str = "sell_price") -> DataFrame:
    """One row: number and percent of rows without a price."""
    return df.agg(*_missing_measures(price))


def watch_missing_prices(df: DataFrame, price: str = "sell_price") -> Watched:
    """``missing_prices``, taken while ``rows`` are used."""
    return Watched(df, _missing_measures(price), lambda told: told)


def _missing_measures(price: str) -> list[Column]:
    gone = F.col(price).isNull()
    return [
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(gone).alias("n_missing"),
        (F.avg(gone.cast("double")) * 100).alias("pct_missing"),
    ]


def daily_calendar(df: DataFrame, start: Column, end: Column, date: str = "date") -> DataFrame:
    """Every row of ``df`` once per day from ``start`` to ``end``."""
    return df.withColumn(date, F.explode(F.sequence(start, end, F.expr("interval 1 day"))))


def densify(
    facts: DataFrame,
    start: str | None = None,
    end: str | None = None,
    keys: Sequence[str] = SERIES,
    static: Sequence[str] = (),
    date: str = "date",
    zero_columns: Sequence[str] = ("sales",),
) -> DataFrame:
    """Gap-free daily panel: each series on each day, ``zero_columns`` 0 where no fact exists.

    Days come from a ``sequence`` per series, so there is no cross join. Without bounds, the range of the facts is used.
    Facts must be unique per series and day and have no null keys, which the quality checks establish. Facts outside of
    stated bounds have no day to stand on; :func:`outside_bounds` counts them.
    """
    keys, static = list(keys), list(static)
    if start is None or end is None:
        span = facts.agg(F.min(date).alias("lo"), F.max(date).alias("hi"))
        first = F.lit(start).cast("date") if start else span.select("lo").scalar()
        last = F.lit(end).cast("date") if end else span.select("hi").scalar()
    else:
        first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    labels = [F.first(c, ignorenulls=True).alias(c) for c in static]
    series = facts.groupBy(*keys).agg(*labels) if labels else facts.select(*keys).distinct()
    skeleton = daily_calendar(series, first, last, date)
    dense = skeleton.join(facts.drop(*static), [*keys, date], "left")
    return dense.na.fill(0, list(zero_columns))


def outside_bounds(facts: DataFrame, start: str, end: str, date: str = "date") -> DataFrame:
    """One row: facts before ``start``, after ``end`` and without a date, which a panel with these bounds leaves out."""
    day = F.col(date)
    return facts.agg(
        F.count_if(day < F.lit(start).cast("date")).alias("n_before"),
        F.count_if(day > F.lit(end).cast("date")).alias("n_after"),
        F.count_if(day.isNull()).alias("n_undated"),
    )


def ordered_columns(df: DataFrame) -> DataFrame:
    """Keys and labels first, then the rest in table order."""
    lead = [c for c in (*IDENTIFIERS, "date", "d", "sales", "sell_price", *EVENTS, *SNAP) if c in df.columns]
    return df.select(*lead, *[c for c in df.columns if c not in lead])
