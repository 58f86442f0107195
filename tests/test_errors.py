"""Error measures on small literal arrays."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from larderflow.functions import errors
from larderflow.operators import evaluation


def measure(spark, expr, y_true, y_pred):
    rows = spark.createDataFrame(list(zip(y_true, y_pred)), "y_true double, y_pred double")
    return rows.agg(expr.alias("m")).first()["m"]


FOUR = ([3.0, -0.5, 2.0, 7.0], [2.5, 0.0, 2.0, 8.0])


def test_mae(spark):
    assert measure(spark, errors.mae(), *FOUR) == 0.5


def test_rmse(spark):
    assert measure(spark, errors.rmse(), *FOUR) == pytest.approx(0.375**0.5)


def test_wmape(spark):
    assert measure(spark, errors.wmape(), [10.0, 20.0, 30.0, 40.0], [12.0, 18.0, 32.0, 38.0]) == pytest.approx(8.0)


def test_zero_actuals(spark):
    zeros = ([0.0, 0.0, 0.0], [1.0, 2.0, 3.0])
    assert measure(spark, errors.wmape(), *zeros) == 0.0
    assert measure(spark, errors.mape(), *zeros) == float("inf")


def test_mape_skips_zero_actuals(spark):
    assert measure(spark, errors.mape(), [0.0, 10.0], [5.0, 9.0]) == pytest.approx(10.0)


def test_unknown_pairs_are_counted_not_scored(spark):
    y_true, y_pred = [1.0, None, float("nan"), 4.0], [2.0, 1.0, 1.0, None]
    assert measure(spark, errors.mae(), y_true, y_pred) == 1.0
    assert measure(spark, errors.n_dropped(), y_true, y_pred) == 3


@pytest.mark.parametrize(("base", "model", "expected"), [(25.0, 20.0, 20.0), (20.0, 25.0, -25.0), (0.0, 5.0, 0.0)])
def test_improvement(spark, base, model, expected):
    row = spark.range(1).select(errors.improvement(F.lit(base), F.lit(model)).alias("m")).first()
    assert row["m"] == pytest.approx(expected)


def test_pinball(spark):
    assert measure(spark, errors.pinball(0.9, "y_true", "y_pred"), [10.0, 10.0], [8.0, 12.0]) == pytest.approx(1.0)


def test_bands(spark):
    values = spark.createDataFrame([(9.9,), (10.0,), (20.0,), (30.0,), (30.1,)], "w double")
    found = [r.b for r in values.select(errors.band(F.col("w")).alias("b"), "w").orderBy("w").collect()]
    assert found == ["Excellent", "Good", "Good", "Acceptable", "Needs improvement"]


SCORES = "model string, MAE double, RMSE double, WMAPE double"


def test_comparison_table_rounds_half_even_and_keeps_baseline_at_zero(spark):
    scores = spark.createDataFrame([("base", 1.00005, 2.0, 12.345), ("good", 0.5, 1.0, 10.0)], SCORES)
    rows = evaluation.comparison_table(scores, "base").collect()
    assert [r.model for r in rows] == ["good", "base"]
    assert rows[1].improvement_vs_baseline == "0.0%"
    assert rows[0].improvement_vs_baseline == f"{round((12.345 - 10) / 12.345 * 100, 2)}%"
    assert rows[1].WMAPE == 12.34


def test_comparison_without_baseline(spark):
    scores = spark.createDataFrame([("a", 1.0, 2.0, 3.0)], SCORES)
    assert evaluation.comparison_table(scores).columns == ["model", "MAE", "RMSE", "WMAPE"]


def test_best_model_breaks_ties_by_name_and_may_be_absent(spark):
    scores = spark.createDataFrame([("b", 1.0, 1.0, 5.0), ("a", 1.0, 1.0, 5.0)], SCORES)
    assert evaluation.best_model(scores).first().model == "a"
    assert evaluation.best_model(scores.where("false")).isEmpty()
