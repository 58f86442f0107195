"""Retraining decisions on a stream: keyed state over closed windows, with a timer for the age of a model.

Each model keeps its baseline score and the day it was last trained. A closed window brings its score and means; the model is
to be retrained if it is degraded, drifted or too old. If nothing more arrives for a model, a timer on event time still
calls it too old when its day has come. A decision to retrain counts as training from then on.

Two queries do it: one writes the windows that its watermark has closed, the other reads them as a stream (a state of its own behind
an aggregate is not possible in one query). Windows are closed in the order of their ends, so the second has no late rows.
``decide_table`` is the batch twin: the same rule over a table of windows.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from larderflow.functions import errors
from larderflow.settings import MonitoringSettings
from larderflow.streaming.monitor import WATERMARK, run_available

DECISIONS = (
    "model string, at timestamp, kind string, WMAPE double, degradation double, drifted array<string>, days_since_training int, "
    "reasons array<string>, retrain boolean"
)
STATE = "baseline double, trained timestamp"
_MICRO = dt.timedelta(microseconds=1)


@dataclass(frozen=True)
class Rule:
    """When to retrain. ``reference`` has the means of training for the watched columns; ``trained`` is when models without a
    state were trained. The first window of a model is its baseline."""

    trained: dt.datetime
    reference: Mapping[str, float]
    settings: MonitoringSettings = MonitoringSettings()

    @property
    def life(self) -> dt.timedelta:
        return dt.timedelta(days=self.settings.retrain_interval_days)

    def overdue(self, model: str, state: tuple, until: dt.datetime) -> tuple[list[tuple], tuple]:
        """Decisions by age that fall due up to ``until``."""
        baseline, trained = state
        out = []
        while self.settings.retrain_interval_days > 0 and trained + self.life <= until:
            trained += self.life
            out.append((model, trained, "timer", None, None, None, self.settings.retrain_interval_days, ["age"], True))
        return out, (baseline, trained)

    def window(self, model: str, state: tuple, row) -> tuple[list[tuple], tuple]:
        """The decision on one closed window, after those by age that fall due before it ends."""
        s = self.settings
        out, (baseline, trained) = self.overdue(model, state, row.window_end)
        score = None if pd.isna(row.WMAPE) else float(row.WMAPE)
        baseline = score if baseline is None else baseline
        degradation = (score - baseline) / baseline if score is not None and baseline else None
        drifted = []
        for name, mean in self.reference.items():
            found = getattr(row, f"mean_{name}")
            if mean and not pd.isna(found) and abs(found - mean) / abs(mean) > s.drift_threshold:
                drifted.append(name)
        reasons = []
        if s.retrain_on_performance_drop and degradation is not None and degradation > s.performance_threshold:
            reasons.append("performance")
        if s.retrain_on_drift and drifted:
            reasons.append("drift")
        out.append((model, row.window_end, "window", score, degradation, drifted, (row.window_end - trained).days, reasons, bool(reasons)))
        return out, (baseline, row.window_end if reasons else trained)


def model_windows(
    predictions: DataFrame, watched: Sequence[str] = (), ts: str = "ts", settings: MonitoringSettings = MonitoringSettings(), watermark: str = WATERMARK
) -> DataFrame:
    """(model, window_end, n, WMAPE, mean_...) per model and tumbling window; on a stream the windows that the watermark closes."""
    timed = predictions.withColumn(ts, F.col(ts).cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark(ts, watermark)
    grouped = timed.groupBy("model", F.window(ts, f"{settings.check_interval_days} days")).agg(
        F.count(F.lit(1)).alias("n"), errors.wmape().alias("WMAPE"), *[F.avg(F.col(c).cast("double")).alias(f"mean_{c}") for c in watched]
    )
    # The time of a window is a microsecond before its end.
    return grouped.select("model", F.window_time("window").alias("at"), "n", "WMAPE", *[f"mean_{c}" for c in watched])


def _frame(rows: Sequence[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[part.split()[0] for part in DECISIONS.split(", ")])


def _ended(table: pd.DataFrame) -> Iterator:
    """The windows of a model in order of their ends."""
    return table.assign(window_end=[t.to_pydatetime() + _MICRO for t in table["at"]]).sort_values("window_end").itertuples()


def decide_stream(windows: DataFrame, rule: Rule) -> DataFrame:
    """The decisions on a stream of closed ``model_windows``; a timer goes by the newest window of any model."""

    def step(key: tuple, tables: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        model = key[0]
        baseline, trained = state.get if state.exists else (None, rule.trained)
        held = (None if pd.isna(baseline) else baseline, pd.Timestamp(trained).to_pydatetime())
        out: list[tuple] = []
        if state.hasTimedOut:
            out, held = rule.overdue(model, held, dt.datetime.fromtimestamp(state.getCurrentWatermarkMs() / 1000, dt.UTC).replace(tzinfo=None))
        else:
            for row in _ended(pd.concat(list(tables))):
                found, held = rule.window(model, held, row)
                out += found
        state.update(held)
        if rule.settings.retrain_interval_days > 0:
            due = int((held[1] + rule.life).replace(tzinfo=dt.UTC).timestamp() * 1000)
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield _frame(out)

    timed = windows.withWatermark("at", "0 seconds")
    return timed.groupBy("model").applyInPandasWithState(step, DECISIONS, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def run_decisions(predictions: DataFrame, rule: Rule, windows: str, decided: str, checkpoint: str) -> None:
    """Bring windows and decisions up to date with all predictions that are there; a restart goes on where the last run ended.

    ``windows`` and ``decided`` are the Parquet tables written, ``checkpoint`` holds the state of both queries.
    """
    closed = model_windows(predictions, list(rule.reference), settings=rule.settings)
    run_available(closed, windows, f"{checkpoint}/windows")
    again = predictions.sparkSession.readStream.schema(closed.schema).parquet(windows)
    run_available(decide_stream(again, rule), decided, f"{checkpoint}/decided")


def decide_table(windows: DataFrame, rule: Rule) -> DataFrame:
    """The decisions on a table of closed ``model_windows``, as the stream makes them."""
    newest = windows.agg(F.max("at")).first()[0]
    until = rule.trained if newest is None else newest.replace(microsecond=newest.microsecond // 1000 * 1000)  # timers know milliseconds

    def step(table: pd.DataFrame) -> pd.DataFrame:
        model, held, out = table["model"].iloc[0], (None, rule.trained), []
        for row in _ended(table):
            found, held = rule.window(model, held, row)
            out += found
        return _frame(out + rule.overdue(model, held, until)[0])

    return windows.groupBy("model").applyInPandas(step, DECISIONS)
