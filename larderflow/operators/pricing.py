"""Price features across all stores and dates of an item."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larderflow.operators.ranks import average_percent_rank, value_ranks

EPSILON = 1e-8


def with_relative_price(
    df: DataFrame, price: str = "sell_price", item: Sequence[str] = ("item_id",), fitted: DataFrame | None = None
) -> DataFrame:
    """Price over the item's mean price. ``fitted`` takes the mean from other rows, such as the training period."""
    means = (df if fitted is None else fitted).groupBy(*item).agg(F.avg(price).alias("_mean"))
    return (
        df.join(means, list(item), "left")
        .withColumn("price_relative", F.col(price) / (F.col("_mean") + F.lit(EPSILON)))
        .drop("_mean")
    )


def with_price_rank(df: DataFrame, price: str = "sell_price", item: Sequence[str] = ("item_id",)) -> DataFrame:
    """Average rank of the price within the item, as a share of the item's priced rows."""
    return average_percent_rank(df, price, item, "price_rank")


def with_price_position(df: DataFrame, price: str = "sell_price", item: Sequence[str] = ("item_id",)) -> DataFrame:
    """``price_relative`` and ``price_rank`` by one lookup: the facts are shuffled a single time, by item and price.

    The counted prices of an item give its mean as well as the ranks, so the facts are not shuffled by item alone, where all
    rows of a large item would meet.
    """
    item = list(item)
    ranked = value_ranks(df.select(*item, price), price, item)
    means = ranked.groupBy(*item).agg((F.sum(F.col("n") * F.col(price)) / F.sum("n")).alias("_mean"))
    rank = (F.col("below") + (F.col("n") + 1) / 2) / F.col("total")
    lookup = ranked.join(means, item).select(
        *item, price, (F.col(price) / (F.col("_mean") + F.lit(EPSILON))).alias("price_relative"), rank.alias("price_rank")
    )
    return df.join(lookup, [*item, price], "left")
