"""From fitted model to decision: compare with baselines, keep the score, look for drift, decide on retraining and promotion."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larderflow.operators import monitoring
from larderflow.operators.boosting import BoostedTrees, feature_names, fit, predict
from larderflow.operators.evaluation import comparison_table, metrics
from larderflow.schemas import SERIES
from larderflow.settings import Settings
from larderflow.sources.files import append_once, read_history

LEARNED = "boosted_trees"
# One-day-ahead baselines that the feature table holds already.
BASELINES = {"naive": "lag_1", "seasonal_naive": "lag_7", "moving_avg_7": "rolling_mean_7"}


@dataclass(frozen=True)
class Judgement:
    """What one round of evaluation found; each a DataFrame of a few rows."""

    scores: DataFrame
    comparison: DataFrame
    drift: DataFrame
    degradation: DataFrame
    retrain: DataFrame
    promotion: DataFrame | None


def beside_baselines(
    model: BoostedTrees,
    rows: DataFrame,
    baselines: Mapping[str, str] = BASELINES,
    target: str = "sales",
    keys: Sequence[str] = SERIES,
    date: str = "date",
) -> DataFrame:
    """``(keys, date, y_true, model, y_pred)``: the learned model and the baselines on the very same rows."""
    scored = predict(model, rows, "_learned")
    columns = {LEARNED: "_learned", **baselines}
    listed = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).cast("double").alias("y_pred")) for m, c in columns.items()])
    long = scored.select(*keys, date, F.col(target).alias("y_true"), F.explode(listed).alias("_p"))
    return long.select(*keys, date, "y_true", "_p.model", "_p.y_pred")


def fit_by_split(features: DataFrame, names: Sequence[str], settings: Settings = Settings(), target: str = "sales") -> BoostedTrees:
    """The model of the split ``train``, stopped by the split ``val``."""
    train, val = (features.where(F.col("split") == s) for s in ("train", "val"))
    return fit(train, names, target, settings.boosting, validation=val)


def judge(
    model: BoostedTrees,
    features: DataFrame,
    history: str,
    run: int,
    evaluated: Column,
    trained: Column,
    production: DataFrame | None = None,
    settings: Settings = Settings(),
    target: str = "sales",
) -> Judgement:
    """Evaluate a model on the split ``test`` and decide.

    Its score is appended to the metric history at ``history`` under the number ``run`` (the same run again replaces itself).
    Degradation is the newest score of the history against the first; drift compares the features' test period with
    training. With ``production``, a table with the WMAPE of the model in use, it is also decided whether this one takes its place.
    """
    test = features.where(F.col("split") == "test")
    predictions = beside_baselines(model, test, target=target)
    scores = metrics(predictions)
    own = scores.where(F.col("model") == LEARNED)
    spark = features.sparkSession
    append_once(own.select(evaluated.cast("timestamp").alias("timestamp"), "MAE", "RMSE", "WMAPE"), history, "judged", run)
    past = read_history(spark, history)
    first = past.agg(F.min_by("WMAPE", "timestamp")).first()[0]
    watched = [c for c in feature_names(model) if c in features.columns]
    reference = monitoring.profile(features.where(F.col("split") == "train"), watched)
    drift = monitoring.detect_drift(reference, test, watched, settings.monitoring.drift_threshold)
    worse = monitoring.degradation(past, first, settings.monitoring.performance_threshold)
    retrain = monitoring.retrain_decision(worse, drift, trained, evaluated, settings.monitoring)
    promotion = None
    if production is not None:
        promotion = monitoring.promotion_decision(own, production, settings.monitoring.min_improvement)
    return Judgement(scores, comparison_table(scores, baseline=settings.baseline_model), drift, worse, retrain, promotion)
