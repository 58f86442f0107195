"""Windowed monitoring of a stream of ``(ts, y_true, y_pred)``.

The same functions run on batch tables, which gives the batch twin of each stream.
"""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from larderflow.functions import errors
from larderflow.operators.monitoring import relative_shift
from larderflow.settings import MonitoringSettings
from larderflow.sources.files import append_once

WATERMARK = "1 day"


def _interval(settings: MonitoringSettings) -> str:
    return f"{settings.check_interval_days} days"


def windowed_metrics(
    predictions: DataFrame,
    ts: str = "ts",
    settings: MonitoringSettings = MonitoringSettings(),
    watermark: str = WATERMARK,
    by: Sequence[str] = (),
) -> DataFrame:
    """MAE, RMSE and WMAPE per tumbling event-time window; rows later than the watermark are dropped by the stream."""
    timed = predictions.withColumn(ts, F.col(ts).cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark(ts, watermark)
    return (
        timed.groupBy(F.window(ts, _interval(settings)), *by)
        .agg(
            F.count(F.lit(1)).alias("n"),
            errors.mae().alias("MAE"),
            errors.rmse().alias("RMSE"),
            errors.wmape().alias("WMAPE"),
        )
        .select(
            F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by, "n", "MAE", "RMSE", "WMAPE"
        )
    )


def windowed_drift(
    values: DataFrame,
    profile: DataFrame,
    columns: Sequence[str],
    ts: str = "ts",
    settings: MonitoringSettings = MonitoringSettings(),
    watermark: str = WATERMARK,
) -> DataFrame:
    """Mean of each column per window against a saved static profile."""
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).alias("current_mean")) for c in columns]
    timed = values.withColumn(ts, F.col(ts).cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark(ts, watermark)
    means = (
        timed.groupBy(F.window(ts, _interval(settings)))
        .agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in columns])
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), F.inline(F.array(*pairs)))
    )
    reference = profile.select("column", F.col("mean").alias("reference_mean"))
    return (
        means.join(reference, "column")
        .withColumn("drift_score", relative_shift(F.col("reference_mean"), F.col("current_mean")))
        .withColumn("has_drift", F.coalesce(F.col("drift_score") > settings.drift_threshold, F.lit(False)))
        .select("window_start", "window_end", "column", "drift_score", "has_drift", "reference_mean", "current_mean")
    )


class LateRows(StreamingQueryListener):
    """Counts, batch by batch, the rows that queries dropped for arriving after the watermark.

    A query's own reports only go back over its last batches; this listener hears of every batch.
    """

    def __init__(self) -> None:
        self.batches: dict[str, dict[int, int]] = {}
        self.ended: set[str] = set()

    def onQueryStarted(self, event) -> None:
        self.batches.setdefault(str(event.runId), {})

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        dropped = sum(op.numRowsDroppedByWatermark for op in progress.stateOperators)
        self.batches.setdefault(str(progress.runId), {})[progress.batchId] = dropped

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.runId))

    def total(self, query: StreamingQuery, timeout: float = 30.0) -> int:
        """Rows that an ended query dropped; events arrive a little after the query has ended."""
        run, until = str(query.runId), time.monotonic() + timeout
        while run not in self.ended and time.monotonic() < until:
            time.sleep(0.05)
        return sum(self.batches.get(run, {}).values())


def run_available(stream: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """Process all available input into a parquet table and stop; a restart goes on from the checkpoint."""
    query = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def run_into_history(stream: DataFrame, path: str, checkpoint: str, source: str = "stream") -> StreamingQuery:
    """Append a stream of metric rows to the metric history, each batch exactly once.

    A batch that failed half-way or whose commit was lost is run again with the same number and replaces what it wrote.
    """
    query = (
        stream.writeStream.foreachBatch(lambda batch, number: append_once(batch, path, source, number))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def run_counting_late_rows(stream: DataFrame, output: str, checkpoint: str) -> tuple[StreamingQuery, int]:
    """:func:`run_available`, and how many rows of all its batches came after the watermark and were dropped."""
    listener, streams = LateRows(), stream.sparkSession.streams
    streams.addListener(listener)
    try:
        query = run_available(stream, output, checkpoint)
        return query, listener.total(query)
    finally:
        streams.removeListener(listener)
