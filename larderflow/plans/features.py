"""All features in one plan, and the training tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from larderflow.functions.calendar import date_feature_names, event_vocabulary, with_cyclical, with_date_parts, with_events
from larderflow.operators.encoding import with_codes
from larderflow.operators.fill import fill_features
from larderflow.operators.history import (
    add_rolling,
    diff_columns,
    lag_columns,
    lag_names,
    price_change_column,
    rolling_names,
    with_ratios,
)
from larderflow.operators.pricing import with_price_position
from larderflow.operators.series import block_window, own_rows, with_blocks
from larderflow.schemas import CATEGORIES, SERIES, SNAP, SPLITS
from larderflow.settings import FeatureSettings


def feature_columns(
    settings: FeatureSettings = FeatureSettings(), include_target: bool = False, include_identifiers: bool = False
) -> list[str]:
    """Names of the model features, in table order."""
    names = date_feature_names()
    names += lag_names(settings.lag_periods) + rolling_names(settings.rolling_windows)
    names += ["price_change_7", "price_relative", "price_rank", "sell_price", "ratio_7_28", "ratio_14_28"]
    names += [f"{c}_encoded" for c in CATEGORIES]
    names += ["has_event", *SNAP]
    if include_target:
        names.append("sales")
    if include_identifiers:
        names += ["id", "item_id", "store_id", "date"]
    return names


def create_features(
    df: DataFrame,
    settings: FeatureSettings = FeatureSettings(),
    include_cyclical: bool = False,
    include_diff: bool = False,
    event_types: Sequence[str] | None = None,
    keys: Sequence[str] = SERIES,
    gap_free: bool = False,
    exclude_current: bool = False,
    codes: DataFrame | None = None,
) -> DataFrame:
    """Date, event, price, lag, difference, rolling, ratio and category features.

    Everything that needs the series order is one window stage over one shuffle. ``gap_free=True`` states that every
    series has a row for every day and saves a shuffle; without it days may be missing. Event types are those of the
    data unless named: one more pass over that column, so name them where the calendar is at hand.
    """
    w = block_window(keys, "date")
    columns = lag_columns(w, "sales", settings.lag_periods)
    reach = max(settings.lag_periods)
    if include_diff:
        columns |= diff_columns(w, "sales", settings.diff_periods)
        reach = max(reach, *settings.diff_periods)
    reach = max(reach, *[size for size, _ in settings.rolling_windows])
    priced = "sell_price" in df.columns
    if priced:
        columns |= price_change_column(w)
        reach = max(reach, 7)
    # Codes are joined before rows are copied into the halos of blocks, so the copies are not looked up again.
    out = with_codes(df, codes=codes)
    out = with_price_position(out) if priced else out
    out = with_blocks(out, keys, "date", before=reach, gap_free=gap_free).withColumns(columns)
    out = own_rows(add_rolling(out, w, "sales", settings.rolling_windows, exclude_current))
    out = with_ratios(out)
    # Columns that need only their own row come last, so that no shuffle carries them.
    out = with_date_parts(out)
    if include_cyclical:
        out = with_cyclical(out)
    if event_types is None:
        event_types = event_vocabulary(df) if "event_type_1" in df.columns else ()
    return with_events(out, event_types)


def training_features(
    df: DataFrame,
    settings: FeatureSettings = FeatureSettings(),
    per_split: bool = False,
    exclude_current: bool = True,
    **options,
) -> DataFrame:
    """Features of a panel with a ``split`` column, without rows that miss a lag or rolling value.

    Features are built on the whole panel and split afterwards, so validation rows see their true history.
    ``per_split=True`` builds each split alone: splits no longer than the longest lag then have no rows left.
    """
    needed = lag_names(settings.lag_periods) + rolling_names(settings.rolling_windows)
    if not per_split:
        built = create_features(df, settings, exclude_current=exclude_current, **options)
        return fill_features(built, needed, "drop")
    parts = [
        fill_features(
            create_features(df.where(f"split = '{s}'"), settings, exclude_current=exclude_current, **options),
            needed,
            "drop",
        )
        for s in SPLITS
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
