"""Forecast error measures as aggregate expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper bounds of the WMAPE bands, in percent.
BANDS = ((10, "Excellent"), (20, "Good"), (30, "Acceptable"))
WORST_BAND = "Needs improvement"


def _pair(y_true: str, y_pred: str) -> tuple[Column, Column]:
    """Both values where both are known; a pair with a null or NaN counts for no measure."""
    y, f = F.col(y_true).cast("double"), F.col(y_pred).cast("double")
    known = y.isNotNull() & f.isNotNull() & ~F.isnan(y) & ~F.isnan(f)
    return F.when(known, y), F.when(known, f)


def mae(y_true: str = "y_true", y_pred: str = "y_pred") -> Column:
    y, f = _pair(y_true, y_pred)
    return F.avg(F.abs(y - f))


def rmse(y_true: str = "y_true", y_pred: str = "y_pred") -> Column:
    y, f = _pair(y_true, y_pred)
    return F.sqrt(F.avg((y - f) * (y - f)))


def wmape(y_true: str = "y_true", y_pred: str = "y_pred") -> Column:
    """Sum of absolute errors over sum of absolute actuals, in percent; 0 when all actuals are 0."""
    y, f = _pair(y_true, y_pred)
    scale = F.sum(F.abs(y))
    return F.when(scale == 0, F.lit(0.0)).otherwise(F.try_divide(F.sum(F.abs(y - f)), scale) * 100)


def mape(y_true: str = "y_true", y_pred: str = "y_pred") -> Column:
    """Mean absolute percentage error over non-zero actuals; infinite when there are none."""
    y, f = _pair(y_true, y_pred)
    share = F.when(y != 0, F.abs(F.try_divide(y - f, y)))
    return F.coalesce(F.avg(share) * 100, F.lit(float("inf")))


def pinball(quantile: float, y_true: str, y_pred: str) -> Column:
    """Quantile loss."""
    y, f = _pair(y_true, y_pred)
    q = F.lit(float(quantile))
    return F.avg(F.greatest(q * (y - f), (q - 1) * (y - f)))


def n_dropped(y_true: str = "y_true", y_pred: str = "y_pred") -> Column:
    """Pairs left out of the measures because a value is unknown."""
    y, _ = _pair(y_true, y_pred)
    return F.count(F.lit(1)) - F.count(y)


def improvement(baseline: Column, model: Column) -> Column:
    """Percent by which ``model`` is below ``baseline``; 0 for a zero baseline."""
    return F.when(baseline == 0, F.lit(0.0)).otherwise(F.try_divide(baseline - model, baseline) * 100)


def band(value: Column) -> Column:
    """Verbal rating of a WMAPE."""
    (best, best_name), *middle = BANDS
    rated = F.when(value < best, best_name)
    for bound, name in middle:
        rated = rated.when(value <= bound, name)
    return rated.when(value.isNotNull(), WORST_BAND)
