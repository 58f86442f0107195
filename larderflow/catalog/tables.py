"""Derived tables the registered queries read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larderflow.catalog.registry import staged
from larderflow.operators.baselines import backtest
from larderflow.operators.fill import fill_prices
from larderflow.operators.reshape import fill_events
from larderflow.plans.features import create_features
from larderflow.sources import star


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap-free daily panel with unfilled prices."""
    return staged(spark, sf_dir, "panel", star.demand_panel)


def filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with prices, events and SNAP flags filled."""
    return staged(spark, sf_dir, "filled", lambda s, d: fill_events(fill_prices(panel(s, d))))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features of the filled panel."""
    return staged(
        spark,
        sf_dir,
        "features",
        lambda s, d: create_features(
            filled(s, d), include_cyclical=True, include_diff=True, event_types=star.EVENT_TYPES, gap_free=True
        ),
    )


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide raw sales."""
    return staged(spark, sf_dir, "wide", lambda s, d: star.wide_sales(panel(s, d)))


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw weekly prices."""
    return staged(spark, sf_dir, "weekly", star.weekly_prices)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backtest of the standard models over the last week of every series."""
    return staged(spark, sf_dir, "predictions", lambda s, d: backtest(panel(s, d)))
