"""Drift, degradation, decisions and streams."""

from __future__ import annotations

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from larderflow.operators import monitoring
from larderflow.session import fresh_path
from larderflow.sources import files
from larderflow.streaming import monitor

SCORES = "model string, WMAPE double"


def column(spark, **values):
    names = list(values)
    return spark.createDataFrame(list(zip(*values.values())), ", ".join(f"{n} double" for n in names))


def test_drift_is_strictly_above_the_threshold(spark):
    reference = monitoring.profile(column(spark, a=[100.0, 100.0], b=[0.0, 0.0], c=[10.0, 10.0]), ["a", "b", "c", "gone"])
    current = column(spark, a=[115.0, 115.0], b=[5.0, 5.0], d=[1.0, 1.0])
    found = {r.column: (r.drift_score, r.has_drift) for r in monitoring.detect_drift(reference, current, ["a", "b", "c", "d"]).collect()}
    assert found == {"a": (0.15, False), "b": (0.0, False)}
    moved = monitoring.detect_drift(reference, column(spark, a=[116.0, 116.0]), ["a"])
    assert moved.first().has_drift
    row = monitoring.drift_summary(moved).first()
    assert (row.total_features_monitored, row.features_with_drift, row.drift_percentage) == (1, 1, 100.0)


def test_nothing_monitored(spark):
    reference = monitoring.profile(column(spark, a=[1.0]), ["other"])
    row = monitoring.drift_summary(monitoring.detect_drift(reference, column(spark, a=[1.0]), ["a"])).first()
    assert (row.total_features_monitored, row.drift_percentage) == (0, 0.0)


def history(spark, *wmapes):
    rows = [(dt.datetime(2016, 1, 1 + i), 1.0, 1.0, w) for i, w in enumerate(wmapes)]
    return spark.createDataFrame(rows, files.METRIC_HISTORY)


def test_degradation(spark):
    assert monitoring.degradation(history(spark, 30.0, 12.0), 10.0).first().degraded is False
    assert monitoring.degradation(history(spark, 10.0, 12.1), 10.0).first().degraded is True
    assert monitoring.degradation(history(spark), 10.0).first().degraded is False
    zero = monitoring.degradation(history(spark, 5.0), 0.0).first()
    assert zero.degradation is None and zero.degraded is False


@pytest.mark.parametrize(
    ("wmape", "drifted", "days", "reasons"),
    [(11.0, 1.0, 10, []), (13.0, 2.0, 30, ["performance", "drift", "age"]), (11.0, 2.0, 29, ["drift"])],
)
def test_retrain_decision(spark, wmape, drifted, days, reasons):
    drift = monitoring.detect_drift(monitoring.profile(column(spark, a=[1.0]), ["a"]), column(spark, a=[drifted]), ["a"])
    trained = dt.date(2016, 1, 1)
    row = monitoring.retrain_decision(
        monitoring.degradation(history(spark, wmape), 10.0), drift, F.lit(trained), F.lit(trained + dt.timedelta(days=days))
    ).first()
    assert (row.reasons, row.retrain) == (reasons, bool(reasons))


@pytest.mark.parametrize(("candidate", "promote"), [(9.8, True), (9.9, False), (11.0, False)])
def test_promotion(spark, candidate, promote):
    new, old = (spark.createDataFrame([("m", w)], SCORES) for w in (candidate, 10.0))
    assert monitoring.promotion_decision(new, old).first().promote is promote


def test_history_appends(spark):
    path = fresh_path(spark, "history")
    assert files.read_history(spark, path).isEmpty()
    files.append_history(history(spark, 1.0), path)
    files.append_history(history(spark), path)
    files.append_history(history(spark, 2.0), path)
    assert sorted(r.WMAPE for r in files.read_history(spark, path).collect()) == [1.0, 2.0]


SCORED = "ts timestamp, y_true double, y_pred double"


def stream_of(spark, folder):
    return spark.readStream.schema(SCORED).option("maxFilesPerTrigger", 1).parquet(folder)


def put(spark, folder, *days):
    rows = [(dt.datetime(2016, 1, 7) + dt.timedelta(days=d), 10.0, 8.0) for d in days]
    spark.createDataFrame(rows, SCORED).coalesce(1).write.mode("append").parquet(folder)


def test_stream_matches_batch_on_closed_windows_and_drops_late_rows(spark):
    folder, output, state = (fresh_path(spark, n) for n in ("in", "out", "state"))
    put(spark, folder, 0, 3, 6, 15)
    monitor.run_available(monitor.windowed_metrics(stream_of(spark, folder)), output, state)
    batch = monitor.windowed_metrics(spark.read.parquet(folder))
    closed = batch.where("window_end <= timestamp'2016-01-21'").orderBy("window_start").collect()
    found = spark.read.parquet(output).orderBy("window_start").collect()
    assert found == closed and [r.n for r in found] == [3]
    put(spark, folder, 1, 16)
    _, late = monitor.run_counting_late_rows(monitor.windowed_metrics(stream_of(spark, folder)), output, state)
    assert late == 1
    assert spark.read.parquet(output).count() == 1


def test_late_rows_of_more_batches_than_a_query_remembers(spark):
    folder, output, state = (fresh_path(spark, n) for n in ("in", "out", "state"))
    kept = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    try:
        put(spark, folder, 40)
        for day in range(6):
            put(spark, folder, day)
        query, late = monitor.run_counting_late_rows(monitor.windowed_metrics(stream_of(spark, folder)), output, state)
        assert len(query.recentProgress) <= 2 and late >= 5
    finally:
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", kept)


def test_stream_drift(spark):
    folder, output, state = (fresh_path(spark, n) for n in ("in", "out", "state"))
    put(spark, folder, 0, 3, 20)
    profile = monitoring.profile(column(spark, y_true=[8.0]), ["y_true"])
    monitor.run_available(monitor.windowed_drift(stream_of(spark, folder), profile, ["y_true"]), output, state)
    row = spark.read.parquet(output).first()
    assert (row.column, row.drift_score, row.has_drift) == ("y_true", 0.25, True)


def test_merged_moments_equal_direct_profiles(spark):
    """Any period from stored days, with days without values, single values and a large offset."""
    rng = random.Random(8)
    rows = []
    for k in range(60):
        for _ in range(rng.choice([0, 1, 1, 5, 40])):
            rows.append((dt.date(2020, 1, 1) + dt.timedelta(k), 1e6 + rng.gauss(0, 3), None if k % 6 == 0 or rng.random() < 0.3 else rng.gauss(5, 2), None))
    df = spark.createDataFrame(rows, "date date, a double, b double, none double")
    names, path = ["a", "b", "none", "absent"], fresh_path(spark, "moments")
    for half in ("day(date) <= 15", "day(date) > 15"):
        monitoring.store_moments(df.where(half), path, names)
    monitoring.store_moments(df.where("date = date'2020-01-05'"), path, names)  # once more
    monitoring.store_moments(df.where("date = date'2020-01-09'").withColumn("a", F.lit(0.0)), path, names, version=0)  # older
    stored = monitoring.stored_moments(spark, path)
    for first, last in ((None, None), ("2020-01-01", "2020-01-01"), ("2020-01-10", "2020-02-03"), ("2020-02-20", None), (None, "2020-01-06")):
        part = df.where(F.col("date").between(first or "1900-01-01", last or "2100-01-01"))
        direct = {r.column: r for r in monitoring.profile(part, names).collect()}
        merged = {r.column: r for r in monitoring.profile_of(stored, first, last).collect()}
        if part.isEmpty():
            assert not merged
            continue
        assert merged.keys() == direct.keys() == {"a", "b", "none"}
        for column, row in direct.items():
            for name in ("mean", "std", "min", "max"):
                expected = row[name] if row[name] is None else pytest.approx(row[name], rel=1e-7)
                assert merged[column][name] == expected, (column, name, first, last)


def test_merging_in_any_order_gives_the_same(spark):
    df = spark.range(300).selectExpr("date_add(date'2020-01-01', cast(id % 30 as int)) date", "double(id * 37 % 101) a")
    stored = monitoring.moments(df, ["a"])
    weekly = monitoring.merge_moments(stored.withColumn("week", F.weekofyear("day")), ["week", "column"])
    twice = monitoring.merge_moments(weekly).first()
    once = monitoring.merge_moments(stored).first()
    assert (twice.n, twice.min, twice.max) == (once.n, once.min, once.max) == (300, 0.0, 100.0)
    assert (twice.mean, twice.m2) == pytest.approx((once.mean, once.m2))


def test_drift_from_stored_moments(spark):
    df = spark.range(40).selectExpr("date_add(date'2020-01-01', cast(id as int)) date", "double(if(id < 20, 10, 13)) a", "1.0D b")
    stored = monitoring.moments(df, ["a", "b"])
    early, late = monitoring.profile_of(stored, last="2020-01-20"), monitoring.profile_of(stored, first="2020-01-21")
    assert {r.column: (r.has_drift, r.drift_score) for r in monitoring.drift_between(early, late).collect()} == {"a": (True, 0.3), "b": (False, 0.0)}


def test_a_batch_run_again_adds_no_row(spark):
    source, path, checkpoint = (fresh_path(spark, name) for name in ("scores", "history", "checkpoint"))

    def record(day, score):
        row = (dt.datetime(2020, 1, day), 1.0, 2.0, score)
        spark.createDataFrame([row], "timestamp timestamp, MAE double, RMSE double, WMAPE double").coalesce(1).write.mode("append").parquet(source)

    def run():
        schema = "timestamp timestamp, MAE double, RMSE double, WMAPE double"
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        monitor.run_into_history(stream, path, checkpoint)
        return sorted(r.WMAPE for r in files.read_history(spark, path).collect())

    record(1, 10.0)
    record(2, 11.0)
    assert run() == [10.0, 11.0]
    commits = sorted(f for f in os.listdir(f"{checkpoint}/commits") if f.isdigit())
    for name in (commits[-1], f".{commits[-1]}.crc"):  # as if the driver had been lost before it noted that the batch was done
        os.remove(f"{checkpoint}/commits/{name}")
    record(3, 12.0)
    assert run() == [10.0, 11.0, 12.0]
    files.append_once(files.read_history(spark, path).where("WMAPE = 12"), path, "nightly", 7)
    files.append_once(files.read_history(spark, path).where("WMAPE = 12 or WMAPE = 11").limit(1), path, "nightly", 8)
    assert len(files.read_history(spark, path).collect()) == 5
