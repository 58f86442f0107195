"""Missing prices and missing features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larderflow.operators.ranks import column_quantiles, exact_quantiles
from larderflow.operators.series import BLOCK_ROWS, time_chunk
from larderflow.schemas import SERIES
from larderflow.session import written


def _carried(df: DataFrame, columns: Sequence[str], keys: Sequence[str], date: str, days: int) -> DataFrame:
    """``df`` with, per column, the value carried into the row's time chunk and the series' first value.

    Chunks are summarised to their first and last non-null value; only those summaries are windowed by series.
    """
    keys = list(keys)
    summary = df.withColumn("_chunk", time_chunk(date, days)).groupBy(*keys, "_chunk")
    dated = {c: F.when(F.col(c).isNotNull(), F.struct(date, c)) for c in columns}
    ends = []
    for c, pair in dated.items():
        ends += [F.max(pair)[c].alias(f"_last_{c}"), F.min(pair)[c].alias(f"_first_{c}")]
    chunks = summary.agg(*ends)
    order = Window.partitionBy(*keys).orderBy("_chunk")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = []
    for c in columns:
        carried += [
            F.last(f"_last_{c}", ignorenulls=True).over(earlier).alias(f"_carry_{c}"),
            F.first(f"_first_{c}", ignorenulls=True).over(whole).alias(f"_head_{c}"),
        ]
    return df.withColumn("_chunk", time_chunk(date, days)).join(
        chunks.select(*keys, "_chunk", *carried).hint("shuffle_hash"), [*keys, "_chunk"], "left"
    )


def fill_series(
    df: DataFrame,
    columns: Sequence[str] = ("sell_price",),
    keys: Sequence[str] = SERIES,
    date: str = "date",
    backward: bool = True,
    days: int = BLOCK_ROWS,
) -> DataFrame:
    """Forward fill within each series; with ``backward`` leading gaps take the first known value.

    After the forward fill only leading nulls remain, so the backward fill is the series' first non-null value. It reads
    a later price and is therefore not causal.
    """
    so_far = (
        Window.partitionBy(*keys, "_chunk").orderBy(date).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    out = _carried(df, columns, keys, date, days)
    filled = {}
    for c in columns:
        parts = [F.last(c, ignorenulls=True).over(so_far), F.col(f"_carry_{c}")]
        if backward:
            parts.append(F.col(f"_head_{c}"))
        filled[c] = F.coalesce(*parts)
    helpers = ["_chunk", *[f"_carry_{c}" for c in columns], *[f"_head_{c}" for c in columns]]
    return out.withColumns(filled).drop(*helpers).select(*df.columns)


def fill_item_median(
    df: DataFrame, price: str = "sell_price", item: Sequence[str] = ("item_id",), source: DataFrame | None = None
) -> DataFrame:
    """Still-missing prices take the exact median of the item over all stores, from ``source`` if it is given."""
    medians = exact_quantiles(df if source is None else source, price, [0.5], item).select(
        *item, F.element_at("quantiles", 1).alias("_median")
    )
    return (
        df.join(medians, list(item), "left")
        .withColumn(price, F.coalesce(F.col(price), F.col("_median")))
        .drop("_median")
        .select(*df.columns)
    )


def fill_prices(
    df: DataFrame, price: str = "sell_price", keys: Sequence[str] = SERIES, date: str = "date"
) -> DataFrame:
    """Forward fill, backward fill, then item median where a price is still missing.

    After both fills only series without any price miss one. The filled table is written to the shared folder, so the medians of
    the items that have such a series are taken from it, not from another fill; where there is none, they have no rows to
    work on.
    """
    filled = written(fill_series(df, [price], keys, date), "filled")
    unpriced = filled.where(F.col(price).isNull()).select("item_id").distinct()
    source = filled.select("item_id", price).join(unpriced, "item_id", "left_semi")
    return fill_item_median(filled, price, source=source)


def fill_features(
    df: DataFrame,
    columns: Sequence[str],
    method: str = "drop",
    keys: Sequence[str] = SERIES,
    date: str = "date",
    rank_error: float | None = None,
) -> DataFrame:
    """Missing feature values: ``drop`` rows, ``fill_zero``, ``fill_forward`` within series, or ``fill_median``.

    Medians are exact unless a ``rank_error`` is allowed.
    """
    columns = list(columns)
    if method == "drop":
        return df.na.drop(subset=columns)
    if method == "fill_zero":
        return df.na.fill(0.0, columns)
    if method == "fill_forward":
        return fill_series(df, columns, keys, date, backward=False)
    if method == "fill_median":
        entry = F.struct("column", F.element_at("quantiles", 1))
        medians = (
            column_quantiles(df, columns, [0.5], rank_error).agg(F.map_from_entries(F.collect_list(entry)).alias("m")).scalar()
        )
        with_medians = df.withColumn("_medians", medians)
        return with_medians.withColumns(
            {c: F.coalesce(F.col(c).cast("double"), F.col("_medians")[c]) for c in columns}
        ).drop("_medians")
    raise ValueError(f"unknown method: {method}")
