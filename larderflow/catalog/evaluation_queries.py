"""Metric, comparison and explanation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from larderflow.catalog import tables
from larderflow.catalog.forecast_queries import BACKTEST, BOOST_FEATURES, MODELS, fitted, training
from larderflow.catalog.registry import query, staged
from larderflow.catalog.sql import PANEL
from larderflow.functions import errors
from larderflow.operators import evaluation, explain

SCORES = f"""{BACKTEST}, scores as (select model, avg(abs(y_true - y_pred)) mae, sqrt(avg((y_true - y_pred) ** 2)) rmse,
    case when sum(abs(y_true)) = 0 then 0.0 else sum(abs(y_true - y_pred)) / sum(abs(y_true)) * 100 end wmape,
    coalesce(avg(abs((y_true - y_pred) / y_true)) filter (y_true <> 0) * 100, 'inf'::double) mape from backtest group by 1),
    base as (select wmape b from scores where model = 'seasonal_naive')"""
GAIN = "case when b = 0 then 0.0 else (b - wmape) / b * 100 end"


def _scores(spark, sf_dir):
    return evaluation.metrics(tables.predictions(spark, sf_dir))


def _one(spark, sf_dir, expr, name):
    return tables.predictions(spark, sf_dir).groupBy("model").agg(F.round(expr, 6).alias(name))


@query("e01_mae", f"{SCORES} select model, round(mae, 6) mae from scores")
def mae(spark, sf_dir):
    return _one(spark, sf_dir, errors.mae(), "mae")


@query("e02_rmse", f"{SCORES} select model, round(rmse, 6) rmse from scores")
def rmse(spark, sf_dir):
    return _one(spark, sf_dir, errors.rmse(), "rmse")


@query("e03_wmape", f"{SCORES} select model, round(wmape, 6) wmape from scores")
def wmape(spark, sf_dir):
    return _one(spark, sf_dir, errors.wmape(), "wmape")


@query("e04_mape", f"{SCORES} select model, round(mape, 6) mape from scores")
def mape(spark, sf_dir):
    return _one(spark, sf_dir, errors.mape(), "mape")


@query(
    "e05_all_metrics",
    f"""{BACKTEST} select model, horizon, round(avg(abs(y_true - y_pred)), 6) MAE,
        round(sqrt(avg((y_true - y_pred) ** 2)), 6) RMSE,
        round(case when sum(abs(y_true)) = 0 then 0.0 else sum(abs(y_true - y_pred)) / sum(abs(y_true)) * 100 end, 6) WMAPE,
        0::bigint n_dropped from backtest group by 1, 2""",
)
def all_metrics(spark, sf_dir):
    scored = evaluation.metrics(tables.predictions(spark, sf_dir), ["model", "horizon"])
    return scored.withColumns({m: F.round(m, 6) for m in evaluation.METRICS})


@query("e06_improvement", f"{SCORES} select model, round({GAIN}, 4) + 0.0 improvement from scores, base")
def improvement(spark, sf_dir):
    gains = evaluation.improvements(_scores(spark, sf_dir), "seasonal_naive")
    return gains.select("model", (F.round("improvement", 4) + F.lit(0.0)).alias("improvement"))


@query(
    "e07_comparison_table",
    f"""{SCORES} select model, round(mae, 4) MAE, round(rmse, 4) RMSE, round(wmape, 2) WMAPE,
        round({GAIN}, 2) + 0.0 improvement from scores, base""",
)
def comparison_table(spark, sf_dir):
    table = evaluation.comparison_table(_scores(spark, sf_dir), "seasonal_naive")
    gain = F.regexp_replace("improvement_vs_baseline", "%", "").cast("double") + F.lit(0.0)
    return table.withColumn("improvement", gain).drop("improvement_vs_baseline")


@query("e08_best_model", f"{SCORES} select model, round(wmape, 6) WMAPE from scores order by wmape, model limit 1")
def best_model(spark, sf_dir):
    return evaluation.best_model(_scores(spark, sf_dir)).select("model", F.round("WMAPE", 6).alias("WMAPE"))


@query(
    "e09_wmape_bands",
    f"""{BACKTEST}, w as (select model, store_id, case when sum(abs(y_true)) = 0 then 0.0
            else sum(abs(y_true - y_pred)) / sum(abs(y_true)) * 100 end w from backtest group by 1, 2)
        select model, store_id, case when w < 10 then 'Excellent' when w <= 20 then 'Good' when w <= 30 then 'Acceptable'
            else 'Needs improvement' end band from w""",
)
def wmape_bands(spark, sf_dir):
    scored = evaluation.metrics(tables.predictions(spark, sf_dir), ["model", "store_id"])
    return evaluation.with_band(scored).select("model", "store_id", "band")


@query(
    "e10_summary",
    f"""{SCORES} select model best_model, round(wmape, 6) WMAPE, 'seasonal_naive' baseline, round({GAIN}, 4) improvement
        from scores, base order by wmape, model limit 1""",
)
def summary(spark, sf_dir):
    out = evaluation.summary(_scores(spark, sf_dir), "seasonal_naive")
    return out.withColumns({"WMAPE": F.round("WMAPE", 6), "improvement": F.round("improvement", 4)})


@query(
    "e11_actual_vs_predicted",
    f"""{BACKTEST} select date, sum(y_true) filter (model = 'naive') actual,
        {", ".join(f"round(sum(y_pred) filter (model = '{m}'), 6) {m}" for m in MODELS)} from backtest group by 1""",
)
def actual_vs_predicted(spark, sf_dir):
    wide = evaluation.aligned(tables.predictions(spark, sf_dir), MODELS)
    return wide.withColumns({m: F.round(m, 6) for m in MODELS})


@query(
    "e12_metric_bars",
    f"""{SCORES} select model, 'MAE' metric, round(mae, 6) "value" from scores union all select model, 'RMSE', round(rmse, 6)
        from scores union all select model, 'WMAPE', round(wmape, 6) from scores""",
)
def metric_bars(spark, sf_dir):
    return evaluation.metric_bars(_scores(spark, sf_dir)).withColumn("value", F.round("value", 6))


def _background(spark, sf_dir):
    return explain.background_sample(
        training(spark, sf_dir).where("split = 'train'").select("store_id", "item_id", "date", *BOOST_FEATURES),
        BOOST_FEATURES,
    )


def attributed(spark, sf_dir):
    """Attributions of every test row."""
    rows = training(spark, sf_dir).where("split = 'test'")
    return staged(
        spark,
        sf_dir,
        "attributed",
        lambda s, d: explain.tree_attributions(fitted(s, d), rows, ["store_id", "item_id", "date"], _background(s, d)),
    )


@query("x01_background_sample")
def background_sample(spark, sf_dir):
    return _background(spark, sf_dir)


@query("x02_attributions")
def attributions(spark, sf_dir):
    return attributed(spark, sf_dir)


@query(
    "x01_background_size",
    f"""{PANEL}, x as (select split, lag(sales, 28) over (partition by store_id, item_id order by date) lag_28 from panel)
        select least(100, count(*))::bigint n_rows, {len(BOOST_FEATURES)} n_columns from x where lag_28 is not null and split = 'train'""",
)
def background_size(spark, sf_dir):
    """The sample has its size, and each of its rows is a training row."""
    sample, names = _background(spark, sf_dir), list(BOOST_FEATURES)
    rows = training(spark, sf_dir).where("split = 'train'").select(*names)
    inside = sample.join(rows.distinct(), names, "left_semi")
    return inside.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(sample.columns)))


@query(
    "x02_attributions_add_up",
    f"""{PANEL}, x as (select split, lag(sales, 28) over (partition by store_id, item_id order by date) lag_28 from panel)
        select count(*) n_rows, count(*) * {len(BOOST_FEATURES)} n_attributions, 0::bigint n_apart
        from x where lag_28 is not null and split = 'test'""",
)
def attributions_add_up(spark, sf_dir):
    """Base value and attributions of every row make up its prediction."""
    by_row = attributed(spark, sf_dir).groupBy("store_id", "item_id", "date").agg(
        F.count(F.lit(1)).alias("n"),
        (F.max("base_value") + F.sum("attribution") - F.max("prediction")).alias("gap"),
    )
    return by_row.agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("n").alias("n_attributions"), F.count_if(F.abs("gap") > 1e-6).alias("n_apart")
    )


@query("x03_global_importance")
def global_importance(spark, sf_dir):
    return explain.global_importance(attributed(spark, sf_dir))


@query("x04_single_row")
def single_row(spark, sf_dir):
    """The first test row; no other row is explained for it."""
    rows = training(spark, sf_dir).where("split = 'test'")
    key = rows.agg(F.min(F.struct("store_id", "item_id", "date")).alias("k")).select("k.*").first().asDict()
    for column, value in key.items():
        rows = rows.where(F.col(column) == F.lit(value))
    own = explain.tree_attributions(fitted(spark, sf_dir), rows, list(key), _background(spark, sf_dir))
    return explain.explain_row(own, **key)
