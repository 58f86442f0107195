"""Baselines, quantiles, sequences, scaling and scoring on hand-made series."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from larderflow.operators import baselines, scoring, sequences
from larderflow.settings import ForecastSettings

START = dt.date(2016, 1, 1)


def frame(spark, **lengths_or_values):
    rows = []
    for item, values in lengths_or_values.items():
        values = range(1, values + 1) if isinstance(values, int) else values
        rows += [("s", item, START + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "store_id string, item_id string, date date, sales double")


def path(df, item="a"):
    return [r.prediction for r in df.where(F.col("item_id") == item).orderBy("horizon").collect()]


def test_naive(spark):
    out = baselines.naive(frame(spark, a=14), 3)
    assert path(out) == [14.0] * 3
    assert [r.date for r in out.orderBy("horizon").collect()] == [START + dt.timedelta(days=14 + i) for i in range(3)]


def test_seasonal_naive(spark):
    df = frame(spark, a=14, short=6)
    assert path(baselines.seasonal_naive(df)) == [8.0, 9.0, 10.0, 11.0, 12.0, 13.0, 14.0]
    assert path(baselines.seasonal_naive(df, reference_index=True)) == [8.0, 7.0, 6.0, 5.0, 4.0, 3.0, 2.0]
    assert path(baselines.seasonal_naive(df, 9)) == [8.0, 9.0, 10.0, 11.0, 12.0, 13.0, 14.0, 8.0, 9.0]
    assert path(baselines.seasonal_naive(df), "short") == [6.0] * 7


def test_reference_index_before_the_series_uses_the_last_value(spark):
    assert path(baselines.seasonal_naive(frame(spark, a=9), reference_index=True)) == [3.0, 2.0, 1.0, 9.0, 9.0, 9.0, 9.0]


def test_moving_average(spark):
    df = frame(spark, a=10, short=3)
    assert path(baselines.moving_average(df, 2, 4)) == [8.5, 8.5]
    assert path(baselines.moving_average(df, 2, 4), "short") == [2.0, 2.0]


def test_seasonal_average(spark):
    assert path(baselines.seasonal_average(frame(spark, a=21), 2, 7, 3)) == [8.0, 9.0]


def test_backtest_skips_series_without_history(spark):
    df = frame(spark, n1=1, n6=6, n7=7, n8=8, n14=14)
    out = baselines.backtest(df)
    assert {r.item_id for r in out.select("item_id").distinct().collect()} == {"n8", "n14"}
    row = baselines.short_series(df).first()
    assert (row.n_series, row.n_skipped) == (5, 3)
    naive = out.where("item_id = 'n14' and model = 'naive'").orderBy("horizon").collect()
    assert [(r.y_true, r.y_pred) for r in naive] == [(float(v), 7.0) for v in range(8, 15)]
    assert out.count() == 2 * 4 * 7


def test_backtest_is_one_shuffle(spark):
    plan = baselines.backtest(frame(spark, a=20))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan


def test_quantile_forecast_against_numpy(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 30, 120).astype(float)
    out = baselines.quantile_forecast(frame(spark, a=y), horizon=5, window=7, origins=20).orderBy("horizon").collect()
    for r in out:
        residuals = [y[o + r.horizon] - y[o - 6 : o + 1].mean() for o in range(119 - r.horizon, 119 - r.horizon - 20, -1)]
        expected = np.maximum(y[-7:].mean() + np.quantile(residuals, [0.1, 0.5, 0.9]), 0)
        np.testing.assert_allclose([r.p10, r.p50, r.p90], expected, rtol=1e-9)


def test_quantiles_are_ordered_and_short_series_get_their_point(spark):
    rows = baselines.quantile_forecast(frame(spark, a=[0.0, 50.0] * 60, short=5)).collect()
    assert all(0 <= r.p10 <= r.p50 <= r.p90 for r in rows)
    assert {(r.p10, r.p50, r.p90) for r in rows if r.item_id == "short"} == {(3.0, 3.0, 3.0)}


@pytest.mark.parametrize("gap_free", [True, False])
def test_sequences(spark, gap_free):
    settings = ForecastSettings(encoder_length=6, min_encoder_length=3, prediction_length=2)
    out = sequences.build_sequences(frame(spark, a=10), settings=settings, gap_free=gap_free).orderBy("date").collect()
    assert [r.encoder_len for r in out] == [3, 4, 5, 6, 6, 6]
    last = out[-1]
    assert [v[0] for v in last.encoder] == [3.0, 4.0, 5.0, 6.0, 7.0, 8.0]
    assert last.decoder == [9.0, 10.0]
    assert last.relative_idx == [-5, -4, -3, -2, -1, 0, 1, 2]


@pytest.mark.parametrize("gap_free", [True, False])
def test_days_without_target_keep_their_place(spark, gap_free):
    df = frame(spark, a=31).withColumn("sales", F.when(F.dayofyear("date") % 10 != 0, F.col("sales")))
    expected = [r.sales for r in df.orderBy("date").collect()]
    assert None in expected
    out = sequences.build_sequences(df, min_decoder=1, gap_free=gap_free).orderBy("date").collect()
    assert len(out) == 31 - 13 - 1
    for i, r in enumerate(out):
        at = i + 14
        assert r.decoder == expected[at : at + 7]
        assert [v[0] for v in r.encoder] == expected[max(0, at - 28) : at]
        assert r.relative_idx[-1] == len(r.decoder)


def test_sequences_with_roles(spark):
    df = frame(spark, a=24).withColumns({"dow": F.dayofweek("date"), "price": F.col("sales") / 2, "event": F.when(F.col("sales") == 20, "fair")})
    roles = sequences.PanelRoles(
        static_categoricals=("item_id",), known_categoricals=("event",), known_reals=("dow",), unknown_reals=("price",)
    )
    settings = ForecastSettings(encoder_length=3, min_encoder_length=3, prediction_length=2)
    rows = df.orderBy("date").collect()
    out = sequences.build_sequences(df, settings=settings, roles=roles).orderBy("date").collect()
    assert len(out) == 24 - 2 - 2
    for i, r in enumerate(out):
        before, after = rows[i : i + 3], rows[i + 3 : i + 5]
        assert r.static == ["a"]
        assert r.encoder == [[x.sales, float(x.dow), x.price] for x in before] and r.encoder_categories == [[x.event] for x in before]
        assert r.decoder == [x.sales for x in after] and r.decoder_reals == [[float(x.dow)] for x in after]
        assert r.decoder_categories == [[x.event] for x in after]
    bare = sequences.build_sequences(df, settings=settings, roles=sequences.PanelRoles()).first()
    assert bare.static == [] and bare.decoder_reals == [[], []] and len(bare.encoder[0]) == 1


def test_sequences_cross_block_edges(spark):
    out = sequences.build_sequences(frame(spark, a=2500)).orderBy("date").collect()
    assert len(out) == 2500 - 13 - 7
    for i, r in enumerate(out):
        at = i + 14
        assert r.decoder == [float(at + k) for k in range(1, 8)]
        assert r.encoder[-1][0] == at and r.encoder[0][0] == max(1, at - 27)


def test_scaling_round_trip(spark):
    df = frame(spark, a=[1.0, 3.0, 5.0], flat=[4.0, 4.0])
    scaled = sequences.scale_target(df, sequences.fit_scales(df))
    back = scaled.withColumn("back", sequences.unscale(F.col("sales_scaled")))
    assert all(r.back == pytest.approx(r.sales) for r in back.collect())
    assert {r.item_id: r.target_scale for r in scaled.collect()}["flat"] == 1e-8


def test_softplus(spark):
    xs = [-30.0, -1.0, 0.0, 2.0, 800.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double").withColumn("y", sequences.softplus(F.col("x")))
    rows = df.withColumn("back", sequences.inverse_softplus(F.col("y"))).collect()
    np.testing.assert_allclose([r.y for r in rows], np.logaddexp(0, xs), rtol=1e-12)
    np.testing.assert_allclose([r.back for r in rows], xs, rtol=1e-6, atol=1e-9)


REQUEST = "store_id string, item_id string, forecast_horizon int"


def test_scoring(spark):
    forecasts = baselines.quantile_forecast(frame(spark, a=100), horizon=28)
    requests = spark.createDataFrame(
        [("s", "a", 7), ("s", "a", None), ("s", "a", 28), ("s", "a", 100), ("s", None, 7), ("s", "new", 3), (None, "a", 1)], REQUEST
    )
    answers = {(r.item_id, r.forecast_horizon): r.forecasts for r in scoring.score_requests(requests, forecasts).collect()}
    assert {k: len(v) for k, v in answers.items()} == {("a", 7): 7, ("a", 28): 28, ("new", 3): 0}
    points = answers[("a", 7)]
    assert [p.horizon for p in points] == list(range(1, 8))
    assert all(p.p10 <= p.p50 <= p.p90 for p in points)
    reasons = sorted(r.reason for r in scoring.rejected_requests(requests).collect())
    assert reasons == ["forecast_horizon not in 1..28", "item_id missing", "store_id missing"]


def test_backtest_against_pandas(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 9, 60).astype(float)
    out = baselines.backtest(frame(spark, a=y)).toPandas()
    history = pd.Series(y[:-7])
    expected = {
        "naive": [history.iloc[-1]] * 7,
        "seasonal_naive": list(history.iloc[-7:]),
        "moving_avg_7": [history.iloc[-7:].mean()] * 7,
        "moving_avg_28": [history.iloc[-28:].mean()] * 7,
    }
    for model, values in expected.items():
        found = out[out["model"] == model].sort_values("horizon")
        np.testing.assert_allclose(found["y_pred"], values)
        np.testing.assert_allclose(found["y_true"], y[-7:])
