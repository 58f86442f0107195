"""Exact ranks and quantiles without holding a group in one task.

Values are first counted per distinct (key, value). Each key's distinct values are then cut into ranges at a bounded
sample of its own values, ranges are totalled, and the running total inside one range is shifted by the ranges before
it. The cuts only balance work: any cuts give the same exact result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUTS = 255
SAMPLE_STRIDE = 4096


def running_weight(values: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    """Add ``below`` (weight of smaller values of the key) and ``total`` (weight of the key).

    ``values`` holds one row per (keys, value). With no keys the whole table is one group.
    """
    keys = list(keys)
    by_hash = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.xxhash64(F.lit("cut"), value), value)
    sampled = (
        values.where(F.pmod(F.xxhash64(value), F.lit(SAMPLE_STRIDE)) == 0)
        .select(*keys, value)
        .withColumn("_rn", F.row_number().over(by_hash))
        .where(F.col("_rn") <= CUTS)
    )
    cuts = sampled.groupBy(*keys).agg(F.collect_list(value).alias("_cuts"))
    placed = values.join(cuts, keys, "left") if keys else values.withColumn("_cuts", cuts.scalar())
    ranged = placed.withColumn(
        "_range", F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(value))), F.lit(0))
    ).drop("_cuts")
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    earlier = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        ranged.groupBy(*keys, "_range")
        .agg(F.sum(weight).alias("_w"))
        .select(
            *keys,
            "_range",
            F.coalesce(F.sum("_w").over(earlier), F.lit(0)).alias("_before"),
            F.sum("_w").over(whole).alias("total"),
        )
    )
    inside = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.join(totals.hint("shuffle_hash"), [*keys, "_range"])
        .withColumn("below", F.col("_before") + F.coalesce(F.sum(weight).over(inside), F.lit(0)))
        .drop("_before", "_range")
    )


def wide_statistics(df: DataFrame, columns: Sequence[str], measures: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """``(column, <measures>)`` with one row per column: one aggregate over the rows as they are, then its row is turned.

    Values are taken as doubles.
    """
    values = [F.col(c).cast("double") for c in columns]
    told = df.agg(*[measure(v).alias(f"{i}_{name}") for i, v in enumerate(values) for name, measure in measures.items()])
    rows = [F.struct(F.lit(c).alias("column"), *[F.col(f"{i}_{name}").alias(name) for name in measures]) for i, c in enumerate(columns)]
    return told.select(F.inline(F.array(*rows)))


def value_ranks(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """One row per distinct non-null (keys, value): ``n`` equal rows, ``below`` smaller rows, ``total`` rows."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return running_weight(counted, keys, value, "n")


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Per key, ``quantiles``: linearly interpolated quantiles of the non-null values, in the order of ``probs``."""
    ranked = value_ranks(df, value, keys)

    def value_at(rank: Column) -> Column:
        hit = (F.col("below") <= rank) & (rank < F.col("below") + F.col("n"))
        return F.max(F.when(hit, F.col(value)))

    picks = []
    for i, p in enumerate(probs):
        at = F.lit(float(p)) * (F.col("total") - 1)
        picks += [
            value_at(F.floor(at)).alias(f"_lo{i}"),
            value_at(F.ceil(at)).alias(f"_hi{i}"),
            F.max(at - F.floor(at)).alias(f"_part{i}"),
        ]
    picked = ranked.groupBy(*keys).agg(*picks)
    between = [
        F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_part{i}") for i in range(len(probs))
    ]
    return picked.select(*keys, F.array(*between).alias("quantiles"))


def average_percent_rank(
    df: DataFrame, value: str, keys: Sequence[str], output: str = "price_rank"
) -> DataFrame:
    """Add the average rank of each value in its group divided by the group's non-null count; null stays null."""
    ranks = value_ranks(df.select(*keys, value), value, keys).select(
        *keys, value, ((F.col("below") + (F.col("n") + 1) / 2) / F.col("total")).alias(output)
    )
    return df.join(ranks, [*keys, value], "left")


def unpivot_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long ``(column, value)`` rows of the given columns, as doubles."""
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]
    return df.select(F.inline(F.array(*pairs)))


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], rank_error: float | None = None) -> DataFrame:
    """``(column, quantiles)`` for several columns in one pass: exact, or with ``rank_error`` from sketches of bounded size."""
    if rank_error is not None:
        return sketched_quantiles(sketches(df, columns, rank_error), columns, probs).where("quantiles IS NOT NULL")
    return exact_quantiles(unpivot_numeric(df, columns), "value", probs, ["column"])


def sketch_size(rank_error: float) -> int:
    """The size of a KLL sketch whose ranks are off by at most ``rank_error`` (a share of the rows) in 99 of 100 answers.

    Fixed values: 2.296 and 0.9723 are those of the published error formula, 8 and 65535 the sizes that Spark takes.
    """
    if not 0 < rank_error < 1:
        raise ValueError("rank_error must lie between 0 and 1")
    size = math.ceil((2.296 / rank_error) ** (1 / 0.9723))
    if size > 65535:
        raise ValueError(f"a rank error of {rank_error} is finer than sketches go; use exact quantiles")
    return max(8, size)


def sketches(df: DataFrame, columns: Sequence[str], rank_error: float = 0.01, by: Sequence[str] = ()) -> DataFrame:
    """One row per group with a sketch of each column's values, under the column's name; no row is shuffled but into its sketch.

    Sketches are small, can be stored (by day, say) and merged (``merge_sketches``) into those of any union of groups.
    """
    size = sketch_size(rank_error)
    # Undefined values are left out as nulls are.
    values = {c: F.col(c).cast("double") for c in columns}
    return df.groupBy(*by).agg(*[F.kll_sketch_agg_double(F.when(~F.isnan(x), x), size).alias(c) for c, x in values.items()])


def merge_sketches(stored: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    return stored.groupBy(*by).agg(*[F.kll_merge_agg_double(c).alias(c) for c in columns])


def sketched_quantiles(sketched: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """``(by, column, quantiles)`` from a row of sketches; null for a column without values. Quantiles are values that occur."""
    rows = []
    for c in columns:
        some = F.kll_sketch_get_n_double(c) > 0
        found = F.array(*[F.kll_sketch_get_quantile_double(F.when(some, F.col(c)), F.lit(float(p))) for p in probs])
        rows.append(F.struct(F.lit(c).alias("column"), F.when(some, found).alias("quantiles")))
    return sketched.select(*by, F.inline(F.array(*rows)))


def category_codes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Vocabulary ``(column, value, code)``: 0-based position of every distinct value in its column's text order."""
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    values = (
        df.select(*columns)
        .distinct()
        .select(F.inline(F.array(*pairs)))
        .where(F.col("value").isNotNull())
        .distinct()
        .withColumn("_one", F.lit(1).cast("bigint"))
    )
    return running_weight(values, ["column"], "value", "_one").select(
        "column", "value", F.col("below").cast("int").alias("code")
    )
