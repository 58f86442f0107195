"""Features of a gap-free panel taken from its sparse facts.

Most days of most series have no sale. Lags, windows and running statistics of the panel in which such days count as 0
follow from the facts alone: frames are ranges of days, and a frame of n days with c facts has n - c zeros. No skeleton of
days is built, joined or written. A series has at most one fact per day, so a window never holds more rows than there are days.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larderflow.operators.history import DEFAULT_WINDOWS, STATISTICS, with_ratios
from larderflow.schemas import SERIES


def _statistic(name: str, frame, n: Column) -> Column:
    """A statistic over ``n`` days, of which those without a fact are 0; null without any day."""
    y = F.col("_y")
    facts, total = F.count(y).over(frame), F.coalesce(F.sum(y).over(frame), F.lit(0.0))
    zeros = F.greatest(n - facts, F.lit(0))
    if name == "sum":
        return F.when(n > 0, total)
    if name == "mean":
        return F.when(n > 0, total / n)
    if name == "min":
        lowest = F.min(y).over(frame)
        return F.when(n > 0, F.when(zeros > 0, F.least(lowest, F.lit(0.0))).otherwise(lowest))
    if name == "max":
        highest = F.max(y).over(frame)
        return F.when(n > 0, F.when(zeros > 0, F.greatest(highest, F.lit(0.0))).otherwise(highest))
    # Squared deviations inside the facts, of their mean from the mean of all days, and of the zeros from it.
    mean = total / n
    own_mean = F.coalesce(F.try_divide(total, facts), F.lit(0.0))
    inside = F.coalesce(F.var_pop(y).over(frame) * facts, F.lit(0.0))
    return F.when(n > 1, F.sqrt((inside + facts * (own_mean - mean) * (own_mean - mean) + zeros * mean * mean) / (n - 1)))


def sparse_features(
    facts: DataFrame,
    start: str,
    target: str = "sales",
    lags: Sequence[int] = (1, 7, 14, 28),
    diffs: Sequence[int] = (),
    windows: Sequence[tuple[int, Sequence[str]]] = DEFAULT_WINDOWS,
    expanding: Sequence[str] = (),
    exclude_current: bool = False,
    at: Sequence[str] = (),
    keys: Sequence[str] = SERIES,
    date: str = "date",
) -> DataFrame:
    """Lag, difference, rolling, ratio and expanding features of each fact, as if every day since ``start`` were a row.

    ``at`` names days on which each series gets a row whether or not it has a fact then (the days to be forecast, say). Also
    ``zero_run``: days without a fact just before the row. A null target counts as 0, as in the panel. Facts must be unique
    per series and day; those before ``start`` or without a date have no row in the panel and none here.
    """
    for name in {name for _, functions in windows for name in functions} | set(expanding):
        if name not in STATISTICS:
            raise ValueError(f"unknown function: {name}; use one of {STATISTICS}")
    keys = list(keys)
    first = F.lit(start).cast("date")
    rows = facts.where(F.col(date) >= first).withColumn("_y", F.coalesce(F.col(target).cast("double"), F.lit(0.0)))
    if at:
        days = F.explode(F.array(*[F.lit(day).cast("date") for day in at]))
        asked = facts.select(*keys).distinct().select(*keys, days.alias(date)).where(F.col(date) >= first)
        rows = rows.unionByName(asked, allowMissingColumns=True)
    rows = rows.withColumn("_day", F.datediff(date, first))
    w = Window.partitionBy(*keys).orderBy("_day")
    today = w.rangeBetween(0, 0)
    past = F.col("_day")

    def earlier(k: int) -> Column:
        return F.when(past >= k, F.coalesce(F.sum("_y").over(w.rangeBetween(-k, -k)), F.lit(0.0)))

    current = F.coalesce(F.sum("_y").over(today), F.lit(0.0))
    out = {target: current.cast(facts.schema[target].dataType), "_same": F.count("_y").over(today)}
    out |= {f"lag_{k}": earlier(k) for k in lags} | {f"diff_{k}": current - earlier(k) for k in diffs}
    skip = int(exclude_current)
    for size, functions in windows:
        n = F.least(F.lit(size), past + 1 - skip)
        frame = w.rangeBetween(-(size - 1 + skip), -skip)
        out |= {f"rolling_{name}_{size}": _statistic(name, frame, n) for name in functions}
    whole = w.rangeBetween(Window.unboundedPreceding, 0)
    out |= {f"expanding_{name}": _statistic(name, whole, past + 1) for name in expanding}
    last = F.max(F.when(F.col("_y").isNotNull(), F.col("_day"))).over(w.rangeBetween(Window.unboundedPreceding, -1))
    out["zero_run"] = past - 1 - F.coalesce(last, F.lit(-1))
    built = rows.withColumns(out).where(F.col("_y").isNotNull() | (F.col("_same") == 0))
    return with_ratios(built.drop("_y", "_day", "_same"))
