"""Retraining decisions on a stream against their batch twin."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from larderflow.session import fresh_path
from larderflow.settings import MonitoringSettings
from larderflow.streaming import decisions

ROWS = "model string, ts timestamp, y_true double, y_pred double, price double"
START = dt.datetime(2016, 1, 7)  # a window begins here
RULE = decisions.Rule(START - dt.timedelta(days=20), {"price": 10.0}, MonitoringSettings(check_interval_days=7, retrain_interval_days=30))


def put(spark, folder, *rows):
    """(model, day, error in percent, price)"""
    told = [(m, START + dt.timedelta(days=d, hours=5), 100.0, 100.0 + e, float(p)) for m, d, e, p in rows]
    spark.createDataFrame(told, ROWS).coalesce(1).write.mode("append").parquet(folder)


def told(df):
    return sorted((r.model, r.at, r.kind, None if r.WMAPE is None else round(r.WMAPE, 6), tuple(r.drifted or ()), r.days_since_training, tuple(r.reasons), r.retrain) for r in df.collect())


def test_stream_equals_batch_and_goes_on_after_a_restart(spark):
    folder, windows, decided, state = (fresh_path(spark, n) for n in ("in", "windows", "decided", "state"))

    def run():
        stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(folder)
        decisions.run_decisions(stream, RULE, windows, decided, state)
        return told(spark.read.schema(decisions.DECISIONS).parquet(decided))

    def twin(watermark):
        table = decisions.model_windows(spark.read.parquet(folder), ["price"])
        return told(decisions.decide_table(table.where(F.col("at") < F.lit(watermark)), RULE))

    put(spark, folder, ("a", 0, 10, 10), ("b", 1, 10, 10), ("a", 3, 10, 10))
    put(spark, folder, ("a", 8, 11, 10), ("b", 9, 20, 10))  # b is degraded
    put(spark, folder, ("a", 15, 10, 13), ("a", 16, 10, 12))  # a has drifted, which the watermark does not see yet
    first = run()
    assert first == twin(START + dt.timedelta(days=15, hours=5))  # a day before the newest row
    assert [(r[0], r[2], r[6]) for r in first] == [
        ("a", "window", ()), ("a", "timer", ("age",)), ("a", "window", ()), ("b", "window", ()), ("b", "timer", ("age",)), ("b", "window", ("performance",))
    ]
    # After a restart the baselines and days of training are still known; b brings nothing more, so its age decides.
    put(spark, folder, ("a", 24, 30, 10))
    put(spark, folder, ("a", 70, 10, 10))
    put(spark, folder, ("a", 80, 10, 10))
    again = run()
    assert again == twin(START + dt.timedelta(days=79, hours=5))
    assert set(first) < set(again)
    reasons = {(r[0], r[2], r[6]) for r in again}
    assert {("a", "window", ("drift",)), ("a", "window", ("performance",)), ("b", "timer", ("age",)), ("b", "window", ("performance",))} <= reasons
    assert run() == again


@pytest.mark.parametrize("days", [0, 5])
def test_rule_of_age(spark, days):
    rule = decisions.Rule(START, {}, MonitoringSettings(retrain_interval_days=days))
    found, state = rule.overdue("m", (1.0, START), START + dt.timedelta(days=11))
    assert [r[1] for r in found] == [START + dt.timedelta(days=k) for k in ((5, 10) if days else ())]
    assert state == (1.0, START + dt.timedelta(days=10 if days else 0))


def test_windows_without_scores_and_zero_references(spark):
    rows = [("m", START, 0.0, 0.0, None), ("m", START + dt.timedelta(days=7), None, None, 99.0)]
    table = spark.createDataFrame(rows, ROWS)
    rule = decisions.Rule(START, {"price": 0.0})
    found = decisions.decide_table(decisions.model_windows(table, ["price"]), rule).orderBy("at").collect()
    assert [(r.kind, r.reasons, r.degradation) for r in found] == [("window", [], None)] * 2
    assert decisions.decide_table(decisions.model_windows(table.limit(0), ["price"]), rule).collect() == []
