"""Metrics per model and model comparison on long predictions ``(keys, model, date, y_true, y_pred)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larderflow.functions import errors

METRICS = ("MAE", "RMSE", "WMAPE")


def metrics(predictions: DataFrame, by: Sequence[str] = ("model",), y_true: str = "y_true", y_pred: str = "y_pred"):
    """MAE, RMSE and WMAPE per group, with the number of pairs left out."""
    return predictions.groupBy(*by).agg(
        errors.mae(y_true, y_pred).alias("MAE"),
        errors.rmse(y_true, y_pred).alias("RMSE"),
        errors.wmape(y_true, y_pred).alias("WMAPE"),
        errors.n_dropped(y_true, y_pred).alias("n_dropped"),
    )


def mape_by(predictions: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    return predictions.groupBy(*by).agg(errors.mape().alias("MAPE"))


def pinball_by(
    forecasts: DataFrame, quantiles: dict[str, float], by: Sequence[str] = (), y_true: str = "y_true"
) -> DataFrame:
    """Pinball loss of each quantile column."""
    losses = [errors.pinball(q, y_true, c).alias(f"loss_{c}") for c, q in quantiles.items()]
    return forecasts.groupBy(*by).agg(*losses)


def improvements(model_metrics: DataFrame, baseline: str) -> DataFrame:
    """Add ``improvement``, the percent gain in WMAPE over the baseline model; null if the baseline is absent."""
    base = model_metrics.where(F.col("model") == baseline).agg(F.max("WMAPE").alias("w")).scalar()
    return model_metrics.withColumn("_base", base).withColumn(
        "improvement", errors.improvement(F.col("_base"), F.col("WMAPE"))
    ).drop("_base")


def comparison_table(model_metrics: DataFrame, baseline: str | None = None) -> DataFrame:
    """Rounded metrics per model, best WMAPE first, with the improvement as text when a baseline is given.

    Improvements come from unrounded values, so the baseline itself shows 0.
    """
    ranked = model_metrics if baseline is None else improvements(model_metrics, baseline)
    columns = [
        F.col("model"),
        F.bround("MAE", 4).alias("MAE"),
        F.bround("RMSE", 4).alias("RMSE"),
        F.bround("WMAPE", 2).alias("WMAPE"),
    ]
    if baseline is not None:
        columns.append(F.concat(F.bround("improvement", 2).cast("string"), F.lit("%")).alias("improvement_vs_baseline"))
    return ranked.orderBy("WMAPE", "model").select(*columns)


def best_model(model_metrics: DataFrame) -> DataFrame:
    """The model with the lowest WMAPE, by name among equals; no row when there are no models."""
    return model_metrics.orderBy("WMAPE", "model").limit(1)


def with_band(model_metrics: DataFrame) -> DataFrame:
    return model_metrics.withColumn("band", errors.band(F.col("WMAPE")))


def summary(model_metrics: DataFrame, baseline: str) -> DataFrame:
    """Best model, its WMAPE, and its improvement over the baseline."""
    return best_model(improvements(model_metrics, baseline)).select(
        F.col("model").alias("best_model"), "WMAPE", F.lit(baseline).alias("baseline"), "improvement"
    )


def aligned(predictions: DataFrame, models: Sequence[str], by: Sequence[str] = ("date",)) -> DataFrame:
    """Actual and every model's prediction side by side, summed over the series of each date.

    Each row of a series and date has one actual, whichever of the models scored it.
    """
    chosen = predictions.where(F.col("model").isin(*models))
    keys = [c for c in chosen.columns if c not in ("model", "y_true", "y_pred")]
    wide = [F.sum(F.when(F.col("model") == m, F.col("y_pred"))).alias(m) for m in models]
    rows = chosen.groupBy(*keys).agg(F.max("y_true").alias("actual"), *wide)
    return rows.groupBy(*by).agg(F.sum("actual").alias("actual"), *[F.sum(m).alias(m) for m in models])


def metric_bars(model_metrics: DataFrame) -> DataFrame:
    """Long ``(model, metric, value)`` rows."""
    return model_metrics.unpivot("model", list(METRICS), "metric", "value")
