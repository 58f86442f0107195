"""Model artifacts and model cards."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larderflow.operators.boosting import BoostedTrees, NotFitted, described, feature_names, node_table, restored


def save_model(model: BoostedTrees | None, path: str, spark: SparkSession) -> None:
    """Write the nodes of all trees as Parquet and the rest of the model, with its feature list, beside them."""
    if model is None:
        raise NotFitted("no model to save")
    node_table(model, spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
    spark.createDataFrame([(described(model),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/model")


def load_model(path: str, spark: SparkSession) -> BoostedTrees:
    return restored(spark.read.text(f"{path}/model").first().value, spark.read.parquet(f"{path}/nodes"))


def model_card(
    spark: SparkSession,
    model: BoostedTrees,
    name: str,
    version: str,
    kind: str,
    horizon: int,
    metrics: Mapping[str, float],
    trained_on: Column | None = None,
) -> DataFrame:
    """One row describing a model; the feature count comes from the model itself."""
    values = [x for pair in metrics.items() for x in (F.lit(pair[0]), F.lit(float(pair[1])))]
    return spark.range(1).select(
        F.lit(name).alias("model_name"),
        F.lit(version).alias("model_version"),
        F.lit(kind).alias("model_type"),
        F.lit(horizon).alias("forecast_horizon"),
        F.lit(len(feature_names(model))).alias("features_count"),
        (F.current_date() if trained_on is None else trained_on).alias("training_date"),
        (F.create_map(*values) if values else F.expr("map()").cast("map<string,double>")).alias("performance_metrics"),
    )
