"""Batch scoring of forecast requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larderflow.schemas import SERIES
from larderflow.settings import ForecastSettings


def _checked(requests: DataFrame, settings: ForecastSettings) -> DataFrame:
    horizon = F.coalesce(F.col("forecast_horizon"), F.lit(settings.horizon))
    reason = (
        F.when(F.col("store_id").isNull(), "store_id missing")
        .when(F.col("item_id").isNull(), "item_id missing")
        .when(~horizon.between(1, settings.max_horizon), f"forecast_horizon not in 1..{settings.max_horizon}")
    )
    return requests.withColumn("forecast_horizon", horizon).withColumn("reason", reason)


def rejected_requests(requests: DataFrame, settings: ForecastSettings = ForecastSettings()) -> DataFrame:
    """Invalid requests with the reason."""
    return _checked(requests, settings).where(F.col("reason").isNotNull())


def score_points(
    requests: DataFrame, forecasts: DataFrame, settings: ForecastSettings = ForecastSettings()
) -> DataFrame:
    """One row per request and forecast day; requests for unknown series keep one row with null forecasts."""
    valid = _checked(requests, settings).where(F.col("reason").isNull()).drop("reason")
    return _with_forecasts(valid, forecasts)


def _with_forecasts(valid: DataFrame, forecasts: DataFrame) -> DataFrame:
    return valid.join(forecasts, list(SERIES), "left").where(
        F.col("horizon").isNull() | (F.col("horizon") <= F.col("forecast_horizon"))
    )


def score_requests(
    requests: DataFrame,
    forecasts: DataFrame,
    model_name: str = "quantile_average",
    model_version: str = "1.0.0",
    settings: ForecastSettings = ForecastSettings(),
) -> DataFrame:
    """One nested response per valid request: ``forecasts`` is an array of at most ``max_horizon`` points.

    Equal requests are answered once.
    """
    point = F.struct("date", "horizon", "p10", "p50", "p90")
    known = F.when(F.col("horizon").isNotNull(), point)
    valid = _checked(requests, settings).where(F.col("reason").isNull())
    return (
        _with_forecasts(valid.select(*SERIES, "forecast_horizon").distinct(), forecasts)
        .groupBy(*SERIES, "forecast_horizon")
        .agg(F.array_sort(F.collect_list(known)).alias("forecasts"))
        .select(
            *SERIES,
            F.lit(model_name).alias("model_name"),
            F.lit(model_version).alias("model_version"),
            "forecast_horizon",
            "forecasts",
        )
    )
