"""Data quality checks as report rows ``(dataset, check, severity, failed_count, detail)``."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larderflow.schemas import DAY_PREFIX, IDENTIFIERS, UNREADABLE, day_columns

REPORT = T.StructType(
    [
        T.StructField("dataset", T.StringType(), False),
        T.StructField("check", T.StringType(), False),
        T.StructField("severity", T.StringType(), False),
        T.StructField("failed_count", T.LongType(), False),
        T.StructField("detail", T.StringType(), True),
    ]
)
# Key columns, value ranges and the price that calls for a second look.
CALENDAR_KEYS = ("date", "wm_yr_wk", "weekday", "wday", "month", "year", "d")
CALENDAR_RANGES = {"wday": (1, 7), "month": (1, 12)}
PRICE_KEYS = ("store_id", "item_id", "wm_yr_wk", "sell_price")
HIGH_PRICE = 1000

_FAMILIES = {
    "string": {"string"},
    "int": {"tinyint", "smallint", "int", "bigint"},
    "double": {"float", "double"},
}


def schema_issues(df: DataFrame, expected: Mapping[str, str]) -> list[tuple[str, str]]:
    """All missing columns and wrong type families at once; extra columns are fine. Reads no data."""
    found = dict(df.dtypes)
    issues = []
    for name, family in expected.items():
        if name not in found:
            issues.append((f"column:{name}", "missing"))
        elif found[name] not in _FAMILIES[family] and not (name == "date" and found[name] == "date"):
            issues.append((f"column:{name}", f"expected {family}, found {found[name]}"))
    return issues


def _measures(checks: Sequence[tuple]) -> list[Column]:
    """What is counted for each ``(check, severity, failing rows count[, detail])``.

    ``detail``, an aggregate too, says more about a failure; by default it is what stands behind the colon of the check's name.
    """
    measures = []
    for i, (name, _, expr, *detail) in enumerate(checks):
        told = detail[0] if detail else F.lit(name.partition(":")[2] or None)
        measures += [F.coalesce(expr, F.lit(0)).cast("bigint").alias(f"c{i}"), told.cast("string").alias(f"d{i}")]
    return measures


def _report_rows(counts: DataFrame, dataset: str, checks: Sequence[tuple]) -> DataFrame:
    """One row per check from the single row of its measures; ``detail`` is null for checks that pass."""
    rows = [
        F.struct(
            F.lit(name).alias("check"),
            F.lit(severity).alias("severity"),
            F.col(f"c{i}").alias("failed_count"),
            F.when(F.col(f"c{i}") > 0, F.col(f"d{i}")).alias("detail"),
        )
        for i, (name, severity, *_) in enumerate(checks)
    ]
    return counts.select(F.inline(F.array(*rows))).select(
        F.lit(dataset).alias("dataset"), "check", "severity", "failed_count", "detail"
    )


def count_report(df: DataFrame, dataset: str, checks: Sequence[tuple]) -> DataFrame:
    """Run every check (see ``_measures``) in one pass and return one row per check."""
    return _report_rows(df.agg(*_measures(checks)), dataset, checks)


class Watched:
    """Measures of a table taken while something else is done with it, so that they cost no scan of their own.

    Use ``rows`` in place of the table, once, in an action that reads all of it (a write, say); ``result()`` then gives what
    the scanning check gives. It waits for that action, so do not ask before. One number per measure reaches the driver. Only
    rows that the action reads are counted: a limit behind ``rows`` would cut them short.
    """

    def __init__(self, df: DataFrame, measures: Sequence[Column], finish: Callable[[DataFrame], DataFrame]) -> None:
        self._observation = Observation(f"watched-{uuid.uuid4().hex}")
        self._schema = df.agg(*measures).schema
        self._finish = finish
        self.rows = df.observe(self._observation, *measures)

    def result(self) -> DataFrame:
        told = self._observation.get
        spark = self.rows.sparkSession
        return self._finish(spark.createDataFrame([tuple(told[c] for c in self._schema.names)], T.StructType([T.StructField(f.name, f.dataType) for f in self._schema])))


def watch_checks(df: DataFrame, dataset: str, checks: Sequence[tuple]) -> Watched:
    """The report of ``count_report``, taken while ``rows`` are used."""
    return Watched(df, _measures(checks), lambda counts: _report_rows(counts, dataset, checks))


def watch_nulls(df: DataFrame, columns: Sequence[str] | None = None) -> Watched:
    """``null_counts``, taken while ``rows`` are used."""
    columns = list(columns or df.columns)
    return Watched(df, _null_measures(columns), lambda counted: _null_rows(counted, columns))


def watch_date_range(df: DataFrame, date: str = "date") -> Watched:
    """``date_range``, taken while ``rows`` are used."""
    return Watched(df, _range_measures(date), lambda told: told)


def unreadable_checks(columns: Iterable[str]) -> list[tuple]:
    """Rows with a cell that its column could not hold, where the reader kept them; the detail is one such row."""
    return [("unreadable", "error", F.count(UNREADABLE), F.min(UNREADABLE))] if UNREADABLE in columns else []


def null_checks(columns: Iterable[str], severity: str = "error") -> list[tuple[str, str, Column]]:
    return [(f"null:{c}", severity, F.count_if(F.col(c).isNull())) for c in columns]


def _null_measures(columns: Sequence[str]) -> list[Column]:
    return [F.count_if(F.col(c).isNull()).alias(c) for c in columns]


def _null_rows(counted: DataFrame, columns: Sequence[str]) -> DataFrame:
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).alias("n_null")) for c in columns]
    return counted.select(F.inline(F.array(*pairs)))


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, n_null)`` for the given columns in one pass."""
    columns = list(columns or df.columns)
    return _null_rows(df.agg(*_null_measures(columns)), columns)


def range_checks(ranges: Mapping[str, tuple[float, float]]) -> list[tuple[str, str, Column]]:
    return [(f"range:{c}", "error", F.count_if(~F.col(c).between(lo, hi))) for c, (lo, hi) in ranges.items()]


def duplicate_report(df: DataFrame, dataset: str, columns: Sequence[str]) -> DataFrame:
    """Rows beyond the first of each key, nulls counted as one key. Keys are pre-counted, so a hot key is one row."""
    extra = df.groupBy(*columns).agg((F.count(F.lit(1)) - 1).alias("extra"))
    return count_report(extra, dataset, [(f"duplicate:{','.join(columns)}", "error", F.sum("extra"))])


def duplicate_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows after the first per key, as distinct rows with ``copies``. The smallest row counts as the first."""
    columns = list(columns)
    distinct_rows = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("copies"))
    row = F.struct(*df.columns)
    firsts = df.groupBy(*columns).agg(F.min(row).alias("_first"), F.count(F.lit(1)).alias("_n"))
    renamed = firsts.where(F.col("_n") > 1).select(*[F.col(c).alias(f"_{c}") for c in columns], "_first")
    same_key = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns])
    joined = distinct_rows.join(renamed, same_key)
    left_over = F.col("copies") - F.when(row.eqNullSafe(F.col("_first")), 1).otherwise(0)
    return joined.select(*df.columns, left_over.alias("copies")).where("copies > 0")


def _issue_rows(df: DataFrame, dataset: str, issues: Sequence[tuple[str, str]]) -> DataFrame:
    rows = [(dataset, name, "error", 1, detail) for name, detail in issues]
    return df.sparkSession.createDataFrame(rows, REPORT)


def _stack(reports: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), reports)


def sales_checks(df: DataFrame) -> list[tuple]:
    """Null keys, unreadable cells and negative sales of a wide or a long sales table."""
    columns = df.columns
    keys = [c for c in IDENTIFIERS if c in columns]
    days = day_columns(columns)
    if days:
        # The place of the first negative day of a row; its smallest over the rows names the first bad column.
        place = F.expr(f"array_position(transform(array({', '.join(f'`{c}`' for c in days)}), x -> x < 0), true)")
        negative = F.count_if(place > 0)
        detail = F.get(F.array(*[F.lit(c) for c in days]), (F.min(F.when(place > 0, place)) - 1).cast("int"))
    else:
        below = F.col("sales") < 0 if "sales" in columns else F.lit(False)
        negative, detail = F.count_if(below), F.lit("sales")
    return [*null_checks(keys), *unreadable_checks(columns), ("negative_sales", "error", negative, detail)]


def check_sales(df: DataFrame, dataset: str = "sales") -> DataFrame:
    """Schema, day columns, negative sales, null keys and duplicate ids."""
    issues = schema_issues(df, {c: "string" for c in IDENTIFIERS})
    if not day_columns(df.columns):
        issues.append(("day_columns", f"no {DAY_PREFIX}* columns"))
    reports = [_issue_rows(df, dataset, issues), count_report(df, dataset, sales_checks(df))]
    if "id" in df.columns:
        reports.append(duplicate_report(df, dataset, ["id"]))
    return _stack(reports)


def _range_measures(date: str) -> list[Column]:
    day = F.expr(f"try_cast(`{date}` as date)")
    return [
        F.count_if(F.col(date).isNotNull() & day.isNull()).alias("n_bad"),
        F.min(day).alias("first_date"),
        F.max(day).alias("last_date"),
        F.datediff(F.max(day), F.min(day)).alias("span_days"),
    ]


def date_range(df: DataFrame, date: str = "date") -> DataFrame:
    """One row: unparsable dates, first and last date, span in days."""
    return df.agg(*_range_measures(date))


def check_calendar(df: DataFrame, dataset: str = "calendar") -> DataFrame:
    """Schema, ranges, dates that do not parse, null keys (errors), other nulls (warnings), duplicate dates."""
    families = {"date": "string", "weekday": "string", "d": "string"}
    expected = {c: families.get(c, "int") for c in CALENDAR_KEYS}
    keys = [c for c in CALENDAR_KEYS if c in df.columns]
    ranges = {c: r for c, r in CALENDAR_RANGES.items() if c in df.columns}
    checks = [*null_checks(keys), *range_checks(ranges)]
    checks += null_checks([c for c in df.columns if c not in keys and c != UNREADABLE], "warning")
    checks += unreadable_checks(df.columns)
    reports = [_issue_rows(df, dataset, schema_issues(df, expected))]
    if "date" in df.columns:
        unparsed = F.col("date").isNotNull() & F.expr("try_cast(`date` as date)").isNull()
        checks.append(("date_parse", "error", F.count_if(unparsed)))
        reports.append(duplicate_report(df, dataset, ["date"]))
    return _stack([*reports, count_report(df, dataset, checks)])


def price_checks(columns: Sequence[str]) -> list[tuple]:
    """Any null, non-positive prices (errors) and unusually high prices (warning)."""
    checks = [*null_checks([c for c in columns if c != UNREADABLE]), *unreadable_checks(columns)]
    if "sell_price" in columns:
        checks += [
            ("positive:sell_price", "error", F.count_if(F.col("sell_price") <= 0)),
            ("high:sell_price", "warning", F.count_if(F.col("sell_price") > HIGH_PRICE)),
        ]
    return checks


def check_prices(df: DataFrame, dataset: str = "prices") -> DataFrame:
    """Schema and the checks of ``price_checks``."""
    expected = {"store_id": "string", "item_id": "string", "wm_yr_wk": "int", "sell_price": "double"}
    return _stack([_issue_rows(df, dataset, schema_issues(df, expected)), count_report(df, dataset, price_checks(df.columns))])


def check_all(sales: DataFrame, calendar: DataFrame, prices: DataFrame) -> DataFrame:
    """Reports of the three raw tables."""
    return _stack([check_sales(sales), check_calendar(calendar), check_prices(prices)])


def summarise(report: DataFrame) -> DataFrame:
    """Per dataset: number of failing checks by severity and ``passed`` (no failing error)."""
    failing = F.col("failed_count") > 0
    return report.groupBy("dataset").agg(
        F.count_if(failing & (F.col("severity") == "error")).alias("n_errors"),
        F.count_if(failing & (F.col("severity") == "warning")).alias("n_warnings"),
        F.bool_and(~failing | (F.col("severity") != "error")).alias("passed"),
    )


def rejects(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows breaking any rule, with the array of broken rule names."""
    reasons = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return df.withColumn("reasons", reasons).where(F.size("reasons") > 0)


class ValidationFailed(ValueError):
    """Some dataset has failing error checks."""


def gate(sales: DataFrame, calendar: DataFrame, prices: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables unchanged when every dataset passes, else :class:`ValidationFailed`.

    Only failing report rows reach the driver; their number is bounded by the number of columns checked.
    """
    failing = check_all(sales, calendar, prices).where("severity = 'error' and failed_count > 0").collect()
    if failing:
        told = [f"{r.dataset}.{r.check}: {r.failed_count}" + (f" ({r.detail})" if r.detail else "") for r in failing]
        text = "; ".join(told)
        raise ValidationFailed(text)
    return sales, calendar, prices
