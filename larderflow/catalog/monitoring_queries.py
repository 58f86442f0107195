"""Drift, degradation, decision and stream monitoring queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from larderflow.catalog import tables
from larderflow.catalog.forecast_queries import BACKTEST
from larderflow.catalog.registry import query
from larderflow.catalog.sql import PANEL
from larderflow.operators import evaluation, monitoring
from larderflow.session import fresh_path
from larderflow.settings import MonitoringSettings
from larderflow.sources import files, star
from larderflow.streaming import decisions, monitor

WATCHED = ("sales", "sell_price", "snap_CA")


def _split(spark, sf_dir, split):
    return tables.panel(spark, sf_dir).where(F.col("split") == split).select(*WATCHED)


def _profile(split, *picks):
    return " union all ".join(
        f"select '{c}' \"column\", {', '.join(p.format(c=c) for p in picks)} from panel where split = '{split}'" for c in WATCHED
    )


DRIFT = f"""{PANEL}, ref as ({_profile('train', 'avg({c}) m')}), cur as ({_profile('test', 'avg({c}) m')}),
    drift as (select ref."column", case when ref.m = 0 then 0.0 else abs(cur.m - ref.m) / abs(ref.m) end score,
        ref.m reference_mean, cur.m current_mean from ref join cur on ref."column" = cur."column")"""


def _drift(spark, sf_dir):
    reference = monitoring.profile(_split(spark, sf_dir, "train"), WATCHED)
    return monitoring.detect_drift(reference, _split(spark, sf_dir, "test"), WATCHED)


@query(
    "m01_reference_profile",
    f"""{PANEL} {_profile('train', 'round(avg({c}), 4) mean', 'round(stddev_samp({c}), 4) std',
        'cast(min({c}) as double) min', 'cast(max({c}) as double) max')}""",
)
def reference_profile(spark, sf_dir):
    profile = monitoring.profile(_split(spark, sf_dir, "train"), [*WATCHED, "absent"])
    return profile.withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


@query("m02_drift_score", f'{DRIFT} select "column", round(score, 6) drift_score from drift')
def drift_score(spark, sf_dir):
    return _drift(spark, sf_dir).select("column", F.round("drift_score", 6).alias("drift_score"))


@query(
    "m03_drift_flags",
    f"""{DRIFT} select "column", round(score, 6) drift_score, score > 0.15 has_drift, round(reference_mean, 4) reference_mean,
        round(current_mean, 4) current_mean from drift""",
)
def drift_flags(spark, sf_dir):
    digits = {"drift_score": 6, "reference_mean": 4, "current_mean": 4}
    return _drift(spark, sf_dir).withColumns({c: F.round(c, n) for c, n in digits.items()})


@query(
    "m03_drift_from_moments",
    f"""{DRIFT} select "column", round(score, 6) drift_score, score > 0.15 has_drift, round(reference_mean, 4) reference_mean,
        round(current_mean, 4) current_mean from drift""",
)
def drift_from_moments(spark, sf_dir):
    """Both periods merged from stored moments of days; the rows are read once, when their day is stored."""
    path = fresh_path(spark, "moments")
    monitoring.store_moments(tables.panel(spark, sf_dir).select("date", *WATCHED), path, WATCHED)
    stored = monitoring.stored_moments(spark, path)
    reference = monitoring.profile_of(stored, last=star.TRAIN_END)
    drift = monitoring.drift_between(reference, monitoring.profile_of(stored.where(F.col("day") > star.VAL_END)))
    return drift.withColumns({c: F.round(c, n) for c, n in {"drift_score": 6, "reference_mean": 4, "current_mean": 4}.items()})


@query(
    "m04_drift_summary",
    f"""{DRIFT} select count(*) total_features_monitored, count(*) filter (score > 0.15) features_with_drift,
        round(count(*) filter (score > 0.15) * 100.0 / count(*), 6)::double drift_percentage from drift""",
)
def drift_summary(spark, sf_dir):
    return monitoring.drift_summary(_drift(spark, sf_dir)).withColumn("drift_percentage", F.round("drift_percentage", 6))


def _history(spark, sf_dir):
    """One metrics record per backtest day of the seasonal model."""
    days = tables.predictions(spark, sf_dir).where("model = 'seasonal_naive'")
    return evaluation.metrics(days, ["date"]).select(F.col("date").cast("timestamp").alias("timestamp"), "MAE", "RMSE", "WMAPE")


HISTORY = f"""{BACKTEST}, history as (select date, avg(abs(y_true - y_pred)) mae, sqrt(avg((y_true - y_pred) ** 2)) rmse,
    case when sum(abs(y_true)) = 0 then 0.0 else sum(abs(y_true - y_pred)) / sum(abs(y_true)) * 100 end wmape
    from backtest where model = 'seasonal_naive' group by 1)"""


@query(
    "m05_performance_record",
    f"""{BACKTEST} select date '2001-11-05' as "date", round(avg(abs(y_true - y_pred)), 6) MAE,
        round(sqrt(avg((y_true - y_pred) ** 2)), 6) RMSE, round(sum(abs(y_true - y_pred)) / sum(abs(y_true)) * 100, 6) WMAPE
        from backtest where model = 'moving_avg_28'""",
)
def performance_record(spark, sf_dir):
    rows = tables.predictions(spark, sf_dir).where("model = 'moving_avg_28'")
    record = monitoring.performance_record(rows, F.lit("2001-11-05").cast("timestamp"))
    return record.select(F.to_date("timestamp").alias("date"), *[F.round(m, 6).alias(m) for m in evaluation.METRICS])


@query(
    "m06_degradation",
    f"""{HISTORY}, d as (select max_by(wmape, date) w from history) select round(w, 6) current_wmape, 50.0::double baseline_wmape,
        round((w - 50) / 50, 6) degradation, (w - 50) / 50 > 0.2 degraded from d""",
)
def degradation(spark, sf_dir):
    out = monitoring.degradation(_history(spark, sf_dir), 50.0)
    return out.withColumns({c: F.round(c, 6) for c in ("current_wmape", "degradation")})


@query(
    "m07_history_table",
    f"{HISTORY} select date, round(mae, 6) MAE, round(rmse, 6) RMSE, round(wmape, 6) WMAPE from history",
)
def history_table(spark, sf_dir):
    """Written by appending, then read back."""
    path = fresh_path(spark, "history")
    files.append_history(_history(spark, sf_dir), path)
    saved = files.read_history(spark, path)
    return saved.select(F.to_date("timestamp").alias("date"), *[F.round(m, 6).alias(m) for m in evaluation.METRICS])


@query(
    "m08_retrain_decision",
    f"""{HISTORY}, p as (select (max_by(wmape, date) - 50) / 50 > 0.2 degraded from history),
        g as (select {", ".join(f"avg({c}) filter (split = 'train') t_{c}, avg({c}) filter (split = 'test') c_{c}" for c in WATCHED)}
            from panel),
        f as (select {" or ".join(f"abs(c_{c} - t_{c}) / abs(t_{c}) > 0.15" for c in WATCHED)} drifted from g)
        select 57 days_since_training, concat_ws(',', case when degraded then 'performance' end, case when drifted then 'drift' end,
            'age') reasons, true retrain from p, f""",
)
def retrain_decision(spark, sf_dir):
    degraded = monitoring.degradation(_history(spark, sf_dir), 50.0)
    out = monitoring.retrain_decision(
        degraded, _drift(spark, sf_dir), F.lit(star.TRAIN_END).cast("date"), F.lit("2001-11-05").cast("date")
    )
    return out.withColumn("reasons", F.concat_ws(",", "reasons"))


@query(
    "m09_promotion_decision",
    f"""{BACKTEST}, w as (select sum(abs(y_true - y_pred)) filter (model = 'moving_avg_28')
            / sum(abs(y_true)) filter (model = 'moving_avg_28') * 100 c,
            sum(abs(y_true - y_pred)) filter (model = 'seasonal_naive') / sum(abs(y_true)) filter (model = 'seasonal_naive') * 100 p
        from backtest)
        select round(c, 6) candidate_wmape, round(p, 6) production_wmape, round((p - c) / p, 6) relative_gain,
            (p - c) / p >= 0.02 promote from w""",
)
def promotion_decision(spark, sf_dir):
    scores = evaluation.metrics(tables.predictions(spark, sf_dir))
    out = monitoring.promotion_decision(
        scores.where("model = 'moving_avg_28'"), scores.where("model = 'seasonal_naive'")
    )
    return out.withColumns({c: F.round(c, 6) for c in ("candidate_wmape", "production_wmape", "relative_gain")})


WINDOWS = """ev as (select ts, event_type, value y_true, avg(value) over (partition by event_type) y_pred from events),
    win as (select time_bucket(interval 7 days, ts, timestamp '1970-01-01') s, count(*) n, avg(abs(y_true - y_pred)) mae,
        sqrt(avg((y_true - y_pred) ** 2)) rmse, sum(abs(y_true - y_pred)) / sum(abs(y_true)) * 100 wmape,
        avg(y_true) m from ev group by 1),
    closed as (select * from win where s + interval 7 days <= (select max(ts) - interval 1 day from events))"""
WINDOW_PICKS = """cast(s as date) window_start, cast(s + interval 7 days as date) window_end, n, round(mae, 6) MAE,
    round(rmse, 6) RMSE, round(wmape, 6) WMAPE"""


def _scored_events(events, spark, sf_dir):
    """Events with their type's mean value as the prediction; event types are a small fixed set."""
    means = star.table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg("value").alias("y_pred"))
    return events.join(means, "event_type").select("ts", F.col("value").alias("y_true"), "y_pred")


def _event_stream(spark, sf_dir):
    schema = star.table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _windows(df):
    days = {c: F.to_date(c) for c in ("window_start", "window_end")}
    return df.withColumns(days).withColumns({m: F.round(m, 6) for m in evaluation.METRICS})


@query("t01_window_metrics_batch", f"with {WINDOWS} select {WINDOW_PICKS} from win")
def window_metrics_batch(spark, sf_dir):
    events = star.table(spark, sf_dir, "events")
    return _windows(monitor.windowed_metrics(_scored_events(events, spark, sf_dir)))


@query("t01_window_metrics_stream", f"with {WINDOWS} select {WINDOW_PICKS} from closed")
def window_metrics_stream(spark, sf_dir):
    """The stream emits the windows its watermark has closed."""
    stream = monitor.windowed_metrics(_scored_events(_event_stream(spark, sf_dir), spark, sf_dir))
    output = fresh_path(spark, "window-metrics")
    monitor.run_available(stream, output, fresh_path(spark, "window-metrics-state"))
    return _windows(spark.read.schema(stream.schema).parquet(output))


@query(
    "t02_window_drift_stream",
    f"""with {WINDOWS}, ref as (select avg(value) r from events)
        select cast(s as date) window_start, 'value' "column", round(abs(m - r) / abs(r), 6) drift_score,
        abs(m - r) / abs(r) > 0.15 has_drift, round(r, 4) reference_mean, round(m, 4) current_mean from closed, ref""",
)
def window_drift_stream(spark, sf_dir):
    """Window means against a profile of the whole table."""
    profile = monitoring.profile(star.table(spark, sf_dir, "events"), ["value"])
    stream = monitor.windowed_drift(_event_stream(spark, sf_dir), profile, ["value"])
    output = fresh_path(spark, "window-drift")
    monitor.run_available(stream, output, fresh_path(spark, "window-drift-state"))
    out = spark.read.schema(stream.schema).parquet(output)
    return out.select(
        F.to_date("window_start").alias("window_start"),
        "column",
        F.round("drift_score", 6).alias("drift_score"),
        "has_drift",
        F.round("reference_mean", 4).alias("reference_mean"),
        F.round("current_mean", 4).alias("current_mean"),
    )


@query(
    "t02_decisions_stream",
    """with ev as (select ts, event_type model, value y, avg(value) over (partition by event_type) p from events),
        win as (select model, time_bucket(interval 1 day, ts, timestamp '1970-01-01') s, avg(y) m, sum(abs(y - p)) / sum(abs(y)) * 100 wmape
            from ev group by 1, 2),
        closed as (select *, first_value(wmape) over (partition by model order by s) base, (select avg(value) from events) r
            from win where s + interval 1 day <= (select max(ts) - interval 1 day from events)),
        told as (select *, (wmape - base) / base worse, abs(m - r) / abs(r) > 0.05 moved from closed)
        select model, cast(s + interval 1 day as date) "at", round(wmape, 6) WMAPE, round(worse, 6) degradation,
            concat_ws(',', case when worse > 0.05 then 'performance' end, case when moved then 'drift' end) reasons, worse > 0.05 or moved retrain
        from told""",
)
def decisions_stream(spark, sf_dir):
    """Daily decisions by event type on degradation and drift; ages, which depend on the decisions before, are left to the tests."""
    means = star.table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg("value").alias("y_pred"))
    scored = _event_stream(spark, sf_dir).join(means, "event_type")
    stream = scored.select(F.col("event_type").alias("model"), "ts", F.col("value").alias("y_true"), "y_pred")
    level = star.table(spark, sf_dir, "events").agg(F.avg("value")).first()[0]
    settings = MonitoringSettings(performance_threshold=0.05, drift_threshold=0.05, check_interval_days=1, retrain_interval_days=0)
    rule = decisions.Rule(datetime(2024, 1, 1), {"y_true": level}, settings)
    windows, decided, state = (fresh_path(spark, name) for name in ("decision-windows", "decisions", "decision-state"))
    decisions.run_decisions(stream, rule, windows, decided, state)
    out = spark.read.schema(decisions.DECISIONS).parquet(decided)
    return out.select(
        "model", F.to_date("at").alias("at"), F.round("WMAPE", 6).alias("WMAPE"), F.round("degradation", 6).alias("degradation"),
        F.array_join("reasons", ",").alias("reasons"), "retrain",
    )
