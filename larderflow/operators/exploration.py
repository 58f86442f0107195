"""Exploratory aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larderflow.operators.quality import null_counts
from larderflow.operators.ranks import column_quantiles, exact_quantiles, wide_statistics

# Weekday names, Monday first.
WEEKDAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def head(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    """First rows in a stated order."""
    return df.orderBy(*order).limit(n)


def info(df: DataFrame) -> DataFrame:
    """``(position, column, type, non_null)`` of every column."""
    dtypes = F.create_map(*[F.lit(x) for pair in df.dtypes for x in pair])
    positions = F.create_map(*[x for i, c in enumerate(df.columns) for x in (F.lit(c), F.lit(i))])
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return null_counts(df).select(
        positions[F.col("column")].alias("position"),
        "column",
        dtypes[F.col("column")].alias("type"),
        (total - F.col("n_null")).alias("non_null"),
    )


def describe(df: DataFrame, columns: Sequence[str], rank_error: float | None = None) -> DataFrame:
    """Count, mean, std, min, quartiles and max per column; quartiles are exact unless a ``rank_error`` is allowed."""
    measures = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    basics = wide_statistics(df, columns, measures)
    quartiles = column_quantiles(df, columns, [0.25, 0.5, 0.75], rank_error).select(
        "column",
        F.element_at("quantiles", 1).alias("p25"),
        F.element_at("quantiles", 2).alias("p50"),
        F.element_at("quantiles", 3).alias("p75"),
    )
    return basics.join(quartiles, "column", "left").select("column", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def zero_share(df: DataFrame, target: str = "sales") -> DataFrame:
    """Percent of rows with zero sales."""
    return df.agg((F.avg((F.col(target) == 0).cast("double")) * 100).alias("zero_pct"))


def histogram(df: DataFrame, column: str = "sales", bins: int = 50) -> DataFrame:
    """Equal-width bins ``(bin, lower, upper, n)``; the last bin is closed and empty bins are kept.

    All values equal gives unit width around the value, as plotting libraries do.
    """
    span = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    flat = F.col("lo") == F.col("hi")
    edges = span.select(
        F.struct(
            F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
            (F.when(flat, F.lit(1.0)).otherwise(F.col("hi") - F.col("lo")) / bins).alias("width"),
        ).alias("edge")
    ).scalar()
    placed = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("_x"), edges.alias("edge"))
    number = F.least(F.floor((F.col("_x") - F.col("edge.lo")) / F.col("edge.width")), F.lit(bins - 1)).cast("int")
    counted = placed.groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"), edges.alias("edge"))
    return every.join(counted, "bin", "left").select(
        "bin",
        (F.col("edge.lo") + F.col("bin") * F.col("edge.width")).alias("lower"),
        (F.col("edge.lo") + (F.col("bin") + 1) * F.col("edge.width")).alias("upper"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def box_stats(df: DataFrame, column: str = "sales") -> DataFrame:
    """Exact quartiles, whiskers at the farthest points within 1.5 interquartile ranges, and the outlier count."""
    quartiles = exact_quantiles(df, column, [0.25, 0.5, 0.75]).scalar()
    x, q = F.col(column), F.col("_q")
    reach = (q[2] - q[0]) * 1.5
    inside = x.between(q[0] - reach, q[2] + reach)
    return df.select(column, quartiles.alias("_q")).agg(
        F.max(q[0]).alias("q1"),
        F.max(q[1]).alias("median"),
        F.max(q[2]).alias("q3"),
        F.min(F.when(inside, x)).alias("whisker_low"),
        F.max(F.when(inside, x)).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"),
    )


def total_by(df: DataFrame, by: Sequence[str], target: str = "sales") -> DataFrame:
    return df.groupBy(*by).agg(F.sum(target).alias("total"))


def daily_totals(df: DataFrame) -> DataFrame:
    return total_by(df, ["date"]).orderBy("date")


def category_totals(df: DataFrame) -> DataFrame:
    return total_by(df, ["cat_id"])


def top_stores(df: DataFrame, n: int = 5, target: str = "sales") -> DataFrame:
    """Stores with the highest total sales."""
    return (
        df.groupBy("store_id")
        .agg(F.sum(target).alias("sum"), F.avg(target).alias("mean"), F.stddev_samp(target).alias("std"))
        .orderBy(F.col("sum").desc(), "store_id")
        .limit(n)
    )


def correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    """2 x 2 Pearson correlation matrix in long form ``(row, column, value)``; null for a constant column."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))

    def pearson(c: Column, one: Column, two: Column) -> Column:
        return F.try_divide(c, F.stddev_pop(one) * F.stddev_pop(two))

    cells = {
        (a, a): pearson(F.var_pop(F.col(a)), F.col(a), F.col(a)),
        (a, b): pearson(F.covar_pop(x, y), x, y),
        (b, a): pearson(F.covar_pop(x, y), x, y),
        (b, b): pearson(F.var_pop(F.col(b)), F.col(b), F.col(b)),
    }
    one_row = df.agg(*[v.alias(f"v{i}") for i, v in enumerate(cells.values())])
    rows = [
        F.struct(F.lit(r).alias("row"), F.lit(c).alias("column"), F.col(f"v{i}").alias("value"))
        for i, (r, c) in enumerate(cells)
    ]
    return one_row.select(F.inline(F.array(*rows)))


def weekday_means(df: DataFrame, date: str = "date", target: str = "sales") -> DataFrame:
    """Average sales per weekday with its name."""
    return (
        df.groupBy(F.weekday(date).alias("day_of_week"))
        .agg(F.avg(target).alias("mean_sales"))
        .withColumn("day_name", F.element_at(F.array(*[F.lit(d) for d in WEEKDAYS]), F.col("day_of_week") + 1))
    )
