"""Drift, degradation, retraining and promotion decisions."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larderflow.operators.evaluation import metrics
from larderflow.operators.ranks import wide_statistics
from larderflow.settings import MonitoringSettings


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, mean, std, min, max)`` of the monitored columns that exist, in one pass."""
    present = [c for c in columns if c in df.columns]
    if not present:
        return df.sparkSession.createDataFrame([], "column string, mean double, std double, min double, max double")
    return wide_statistics(df, present, {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max})


def moments(df: DataFrame, columns: Sequence[str], day: str = "date") -> DataFrame:
    """``(day, column, n, mean, m2, min, max)``: what is kept of each day, so that no period needs its rows again.

    ``m2`` is the sum of squared deviations from the day's mean. A day without a value has ``n`` 0; rows without a date are a
    day of their own. One pass; columns that do not exist are skipped, as in ``profile``.
    """
    present = [c for c in columns if c in df.columns]
    if not present:
        return df.sparkSession.createDataFrame([], "day date, column string, n bigint, mean double, m2 double, min double, max double")
    aggregates = []
    for i, c in enumerate(present):
        x = F.col(c).cast("double")
        m2 = F.coalesce(F.var_pop(x) * F.count(x), F.lit(0.0))
        aggregates.append(
            F.struct(
                F.lit(c).alias("column"), F.count(x).alias("n"), F.avg(x).alias("mean"), m2.alias("m2"), F.min(x).alias("min"), F.max(x).alias("max")
            ).alias(f"_{i}")
        )
    daily = df.groupBy(F.to_date(day).alias("day")).agg(*aggregates)
    return daily.select("day", F.inline(F.array(*[f"_{i}" for i in range(len(present))])))


def merge_moments(stored: DataFrame, by: Sequence[str] = ("column",)) -> DataFrame:
    """Moments of all stored rows of each group, whatever days they are of.

    The deviations of the days' means from the common mean come on top of those inside the days. Work grows with the number
    of days, not of rows.
    """
    whole = Window.partitionBy(*by)
    n, total = F.sum("n").over(whole), F.sum(F.col("n") * F.col("mean")).over(whole)
    apart = F.coalesce(F.col("mean") - F.try_divide(total, n), F.lit(0.0))
    told = stored.withColumn("_between", F.col("n") * apart * apart)
    return told.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n")).alias("mean"),
        (F.sum("m2") + F.sum("_between")).alias("m2"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
    )


def profile_of(stored: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """The profile (see ``profile``) of the stored days from ``first`` to ``last``, both included."""
    if first is not None:
        stored = stored.where(F.col("day") >= F.lit(first).cast("date"))
    if last is not None:
        stored = stored.where(F.col("day") <= F.lit(last).cast("date"))
    std = F.when(F.col("n") > 1, F.sqrt(F.try_divide(F.col("m2"), F.col("n") - 1)))
    return merge_moments(stored).select("column", "mean", std.alias("std"), "min", "max")


def store_moments(df: DataFrame, path: str, columns: Sequence[str], day: str = "date", version: int | None = None) -> None:
    """Keep the moments of the days of ``df``, which must hold these days whole.

    Days stored before stay in the files, but the highest ``version`` of a day counts (by default the time of the call), so a day
    can be stored again.
    """
    version = time.time_ns() if version is None else version
    moments(df, columns, day).withColumn("version", F.lit(version).cast("bigint")).write.mode("append").parquet(path)


def stored_moments(spark: SparkSession, path: str) -> DataFrame:
    """The moments of each stored day, as stored last."""
    kept = [c for c in spark.read.parquet(path).columns if c not in ("day", "column", "version")]
    newest = F.max(F.struct("version", *kept)).alias("_kept")
    return spark.read.parquet(path).groupBy("day", "column").agg(newest).select("day", "column", *[f"_kept.{c}" for c in kept])


def relative_shift(reference: Column, current: Column) -> Column:
    """Absolute change of the mean over the reference mean; 0 for a zero reference."""
    return F.when(reference == 0, F.lit(0.0)).otherwise(F.try_divide(F.abs(current - reference), F.abs(reference)))


def detect_drift(
    reference: DataFrame, df: DataFrame, columns: Sequence[str], threshold: float = MonitoringSettings.drift_threshold
) -> DataFrame:
    """Compare a saved profile with current data; columns missing on either side are skipped."""
    return drift_between(reference, profile(df, columns), threshold)


def drift_between(reference: DataFrame, current: DataFrame, threshold: float = MonitoringSettings.drift_threshold) -> DataFrame:
    """Compare two profiles, direct or merged from stored moments."""
    current = current.select("column", F.col("mean").alias("current_mean"))
    score = relative_shift(F.col("reference_mean"), F.col("current_mean"))
    return (
        reference.select("column", F.col("mean").alias("reference_mean"))
        .join(current, "column")
        .withColumn("drift_score", score)
        .withColumn("has_drift", F.coalesce(F.col("drift_score") > threshold, F.lit(False)))
        .select("column", "drift_score", "has_drift", "reference_mean", "current_mean")
    )


def drift_summary(drift: DataFrame) -> DataFrame:
    """Monitored, drifted and percent drifted columns; 0 percent when nothing is monitored."""
    total, drifted = F.count(F.lit(1)), F.count_if("has_drift")
    return drift.agg(
        total.alias("total_features_monitored"),
        drifted.alias("features_with_drift"),
        F.coalesce(F.try_divide(drifted * 100.0, total), F.lit(0.0)).alias("drift_percentage"),
    )


def performance_record(predictions: DataFrame, at: Column | None = None) -> DataFrame:
    """One metrics row with its evaluation time, ready to append to the history."""
    when = F.current_timestamp() if at is None else at
    return metrics(predictions, by=()).select(when.alias("timestamp"), "MAE", "RMSE", "WMAPE")


def degradation(
    history: DataFrame, baseline_wmape: float, threshold: float = MonitoringSettings.performance_threshold
) -> DataFrame:
    """One row: latest WMAPE, its relative increase over the baseline, and whether that exceeds the threshold.

    No history means no degradation; a zero baseline leaves the increase unknown.
    """
    latest = history.agg(F.max_by("WMAPE", "timestamp").alias("current_wmape"))
    base = F.lit(float(baseline_wmape))
    return (
        latest.withColumn("baseline_wmape", base)
        .withColumn("degradation", F.try_divide(F.col("current_wmape") - base, base))
        .withColumn("degraded", F.coalesce(F.col("degradation") > threshold, F.lit(False)))
    )


def retrain_decision(
    degraded: DataFrame,
    drift: DataFrame,
    last_trained: Column,
    today: Column,
    settings: MonitoringSettings = MonitoringSettings(),
) -> DataFrame:
    """One row: whether to retrain, with all reasons (``performance``, ``drift``, ``age``)."""
    any_drift = drift.agg(F.coalesce(F.bool_or("has_drift"), F.lit(False)).alias("d")).scalar()
    flags = degraded.select(
        (F.col("degraded") & F.lit(settings.retrain_on_performance_drop)).alias("_performance"),
        (any_drift & F.lit(settings.retrain_on_drift)).alias("_drift"),
        F.datediff(today, last_trained).alias("days_since_training"),
    )
    reasons = F.array_compact(
        F.array(
            F.when(F.col("_performance"), "performance"),
            F.when(F.col("_drift"), "drift"),
            F.when(F.col("days_since_training") >= settings.retrain_interval_days, "age"),
        )
    )
    return flags.select("days_since_training", reasons.alias("reasons"), (F.size(reasons) > 0).alias("retrain"))


def promotion_decision(
    candidate: DataFrame, production: DataFrame, min_improvement: float = MonitoringSettings.min_improvement
) -> DataFrame:
    """One row: promote the candidate only if it lowers WMAPE by at least ``min_improvement``."""
    current = production.agg(F.max("WMAPE").alias("w")).scalar()
    gain = F.try_divide(F.col("production_wmape") - F.col("candidate_wmape"), F.col("production_wmape"))
    enough = F.col("candidate_wmape") <= F.col("production_wmape") * (1 - min_improvement)
    return (
        candidate.agg(F.max("WMAPE").alias("candidate_wmape"))
        .withColumn("production_wmape", current)
        .withColumn("relative_gain", gain)
        .withColumn("promote", F.coalesce(F.col("relative_gain").isNotNull() & enough, F.lit(False)))
    )
