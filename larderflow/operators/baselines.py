"""Simple forecasters for all series at once.

A forecast needs only the newest rows of a series. ``last_rows`` keeps those with a group limit before the shuffle; each
series then becomes one row with a short newest-first array, and every model is arithmetic on that array.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larderflow.operators.series import last_rows
from larderflow.schemas import SERIES
from larderflow.settings import ForecastSettings


def newest_first(df: DataFrame, keys: Sequence[str], date: str, target: str, n: int) -> DataFrame:
    """One row per series: ``days`` and ``values`` of its last ``n`` rows, newest first."""
    row = F.struct(F.col("_from_end"), F.to_date(date).alias("day"), F.col(target).cast("double").alias("y"))
    gathered = last_rows(df.select(*keys, date, target), keys, date, n).groupBy(*keys).agg(
        F.sort_array(F.collect_list(row)).alias("_rows")
    )
    return gathered.select(*keys, F.col("_rows.day").alias("days"), F.col("_rows.y").alias("values"))


def array_mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
    return F.try_divide(total, F.size(values))


def naive_values(history: Column, horizon: int) -> Column:
    """The last value, ``horizon`` times."""
    return F.array_repeat(F.try_element_at(history, F.lit(1)), horizon)


def seasonal_values(history: Column, horizon: int, season: int, reference_index: bool = False) -> Column:
    """The value one season before each step; histories shorter than a season repeat the last value.

    ``reference_index`` walks backwards from one season ago instead of forwards, and uses the last value where that
    reaches before the series.
    """
    last = F.try_element_at(history, F.lit(1))
    steps = []
    for step in range(horizon):
        distance = season + step % season if reference_index else season - step % season
        value = F.coalesce(F.try_element_at(history, F.lit(distance)), last)
        steps.append(F.when(F.size(history) < season, last).otherwise(value))
    return F.array(*steps)


def average_values(history: Column, horizon: int, window: int) -> Column:
    """Mean of the last ``window`` values, of all if there are fewer."""
    return F.array_repeat(array_mean(F.slice(history, 1, window)), horizon)


def seasonal_average_values(history: Column, horizon: int, season: int, seasons: int) -> Column:
    """Mean of the same season position over the last ``seasons`` seasons; shorter histories use what they have."""
    steps = []
    for step in range(horizon):
        distance = season - step % season
        same = F.array_compact(
            F.array(*[F.try_element_at(history, F.lit(distance + season * k)) for k in range(seasons)])
        )
        steps.append(F.coalesce(array_mean(same), F.try_element_at(history, F.lit(1))))
    return F.array(*steps)


def model_values(
    history: Column, horizon: int, settings: ForecastSettings, reference_index: bool = False
) -> dict[str, Column]:
    """Forecast arrays of the standard models."""
    out = {
        "naive": naive_values(history, horizon),
        "seasonal_naive": seasonal_values(history, horizon, settings.season_length, reference_index),
    }
    for window in settings.averages:
        out[f"moving_avg_{window}"] = average_values(history, horizon, window)
    return out


def _reach(settings: ForecastSettings) -> int:
    return max(2 * settings.season_length, *settings.averages)


def _future(series: DataFrame, keys: Sequence[str], values: Column, horizon: int) -> DataFrame:
    """Explode a forecast array into ``horizon``, ``date`` and ``prediction`` rows after the last day."""
    return series.select(*keys, "days", F.posexplode(values).alias("_step", "prediction")).select(
        *keys,
        (F.col("_step") + 1).alias("horizon"),
        F.date_add(F.element_at("days", 1), F.col("_step") + 1).alias("date"),
        "prediction",
    )


def naive(
    df: DataFrame, horizon: int = 7, keys: Sequence[str] = SERIES, date: str = "date", target: str = "sales"
) -> DataFrame:
    """Last value of each series for the next ``horizon`` days."""
    series = newest_first(df, keys, date, target, 1)
    return _future(series, keys, naive_values(F.col("values"), horizon), horizon)


def seasonal_naive(
    df: DataFrame,
    horizon: int = 7,
    season: int = 7,
    reference_index: bool = False,
    keys: Sequence[str] = SERIES,
    date: str = "date",
    target: str = "sales",
) -> DataFrame:
    """Value of the same season position one season earlier."""
    series = newest_first(df, keys, date, target, 2 * season)
    return _future(series, keys, seasonal_values(F.col("values"), horizon, season, reference_index), horizon)


def moving_average(
    df: DataFrame,
    horizon: int = 7,
    window: int = 7,
    keys: Sequence[str] = SERIES,
    date: str = "date",
    target: str = "sales",
) -> DataFrame:
    """Mean of the last ``window`` values."""
    series = newest_first(df, keys, date, target, window)
    return _future(series, keys, average_values(F.col("values"), horizon, window), horizon)


def seasonal_average(
    df: DataFrame,
    horizon: int = 7,
    season: int = 7,
    seasons: int = 4,
    keys: Sequence[str] = SERIES,
    date: str = "date",
    target: str = "sales",
) -> DataFrame:
    """Mean of the same weekday over the last ``seasons`` weeks."""
    series = newest_first(df, keys, date, target, season * seasons)
    return _future(series, keys, seasonal_average_values(F.col("values"), horizon, season, seasons), horizon)


def backtest(
    df: DataFrame,
    settings: ForecastSettings = ForecastSettings(),
    reference_index: bool = False,
    keys: Sequence[str] = SERIES,
    date: str = "date",
    target: str = "sales",
) -> DataFrame:
    """Hold out the last ``horizon`` rows of each series and forecast them from the rest with every model.

    Output: ``keys, model, horizon, date, y_true, y_pred``. Series without any history before the holdout are left out;
    :func:`short_series` counts them.
    """
    h = settings.horizon
    series = newest_first(df, keys, date, target, h + _reach(settings)).where(F.size("values") > h)
    history = F.slice("values", h + 1, _reach(settings))
    actual = F.reverse(F.slice("values", 1, h))
    days = F.reverse(F.slice("days", 1, h))
    split = series.select(*keys, history.alias("_history"), actual.alias("_actual"), days.alias("_days"))
    models = model_values(F.col("_history"), h, settings, reference_index)
    paths = [F.struct(F.lit(m).alias("model"), values.alias("_pred")) for m, values in models.items()]
    return (
        split.select(*keys, "_actual", "_days", F.inline(F.array(*paths)))
        .select(*keys, "model", F.posexplode(F.arrays_zip("_days", "_actual", "_pred")).alias("_step", "_point"))
        .select(
            *keys,
            "model",
            (F.col("_step") + 1).alias("horizon"),
            F.col("_point._days").alias("date"),
            F.col("_point._actual").alias("y_true"),
            F.col("_point._pred").alias("y_pred"),
        )
    )


def short_series(df: DataFrame, horizon: int = 7, keys: Sequence[str] = SERIES) -> DataFrame:
    """One row: number of series and how many are too short to backtest."""
    lengths = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return lengths.agg(F.count(F.lit(1)).alias("n_series"), F.count_if(F.col("n") <= horizon).alias("n_skipped"))


def interpolated(sorted_values: Column, p: float) -> Column:
    """Linearly interpolated quantile of a short sorted array; null for an empty one."""
    at = F.lit(float(p)) * (F.size(sorted_values) - 1)
    low, high = (F.get(sorted_values, end(at).cast("int")) for end in (F.floor, F.ceil))
    return low + (high - low) * (at - F.floor(at))


def quantile_name(q: float) -> str:
    """``p10`` for 0.1, ``p99_5`` for 0.995."""
    return f"p{q * 100:.10g}".replace(".", "_")


def quantile_forecast(
    df: DataFrame,
    horizon: int = 7,
    window: int = 28,
    origins: int = 56,
    quantiles: Sequence[float] = (0.1, 0.5, 0.9),
    keys: Sequence[str] = SERIES,
    date: str = "date",
    target: str = "sales",
) -> DataFrame:
    """``p10 / p50 / p90`` for 1..horizon days: moving average plus residual quantiles of the last ``origins`` origins.

    Every origin forecasts with the mean of its own last ``window`` values, so residuals are out of sample. Quantiles
    are clamped at 0 and increase with their probability. Series shorter than ``window + horizon`` use the origins they
    have; with none, all quantiles equal the point forecast.
    """
    n = window + origins + horizon
    series = newest_first(df, keys, date, target, n)
    v = F.col("values")
    point = array_mean(F.slice(v, 1, window))
    steps = series.select(
        *keys, "values", F.element_at("days", 1).alias("_last"), point.alias("_point"),
        F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("horizon"),
    )
    h = F.col("horizon")
    # An origin with ``s`` later rows forecasts the row ``s - h + 1`` from the end.
    first, last = h, F.least(h + origins - 1, F.size(v) - window)
    origins_of_step = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    residuals = F.transform(
        origins_of_step,
        lambda s: F.element_at(v, (s - h + 1).cast("int")) - array_mean(F.slice(v, s + 1, window)),
    )
    ordered = steps.withColumn("_resid", F.sort_array(residuals))
    bounds = [
        F.greatest(F.col("_point") + F.coalesce(interpolated(F.col("_resid"), q), F.lit(0.0)), F.lit(0.0)).alias(
            quantile_name(q)
        )
        for q in quantiles
    ]
    return ordered.select(*keys, F.date_add("_last", h).alias("date"), "horizon", *bounds)
