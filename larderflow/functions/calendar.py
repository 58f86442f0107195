"""Date, event and SNAP features."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larderflow.schemas import NO_EVENT

DATE_FEATURES = ("day", "day_of_week", "week_of_year", "month", "quarter", "year", "is_weekend")
# Cycle length of each date part.
CYCLES = {"day_of_week": 7, "day": 31, "month": 12}


def date_parts(date: str = "date") -> dict[str, Column]:
    """Day, ISO weekday (Monday = 0), ISO week, month, quarter, year and weekend flag of a date or date text."""
    day = F.to_date(date)
    return {
        "day": F.dayofmonth(day),
        "day_of_week": F.weekday(day),
        "week_of_year": F.weekofyear(day),
        "month": F.month(day),
        "quarter": F.quarter(day),
        "year": F.year(day),
        "is_weekend": (F.weekday(day) >= 5).cast("int"),
    }


def with_date_parts(df: DataFrame, date: str = "date") -> DataFrame:
    """Add the date parts; existing ``month`` and ``year`` columns are replaced."""
    return df.withColumns(date_parts(date))


def cyclical(columns: Sequence[str] = tuple(CYCLES)) -> dict[str, Column]:
    """Sine and cosine of each date part over its cycle."""
    out: dict[str, Column] = {}
    for c in columns:
        angle = F.col(c) * F.lit(2 * math.pi) / F.lit(CYCLES[c])
        out[f"{c}_sin"] = F.sin(angle)
        out[f"{c}_cos"] = F.cos(angle)
    return out


def with_cyclical(df: DataFrame) -> DataFrame:
    return df.withColumns(cyclical())


def has_event(name: str = "event_name_1") -> Column:
    """1 on days with an event; both null and ``'None'`` mean no event."""
    return (F.col(name).isNotNull() & (F.col(name) != NO_EVENT)).cast("int")


def event_type_flags(types: Sequence[str], column: str = "event_type_1") -> dict[str, Column]:
    """One 0/1 column per event type of a fixed vocabulary, null counted as ``'None'``."""
    filled = F.coalesce(F.col(column), F.lit(NO_EVENT))
    return {f"event_type_{t}": (filled == t).cast("int") for t in types}


MAX_EVENT_TYPES = 1000


def event_vocabulary(calendar: DataFrame, column: str = "event_type_1") -> list[str]:
    """Event types of the calendar, sorted; read from the dimension, so it does not grow with the facts.

    Each type becomes a feature column, so more than ``MAX_EVENT_TYPES`` of them raise.
    """
    types = calendar.select(F.coalesce(F.col(column), F.lit(NO_EVENT)).alias("t")).distinct().orderBy("t")
    rows = types.limit(MAX_EVENT_TYPES + 1).collect()
    if len(rows) > MAX_EVENT_TYPES:
        raise ValueError(f"{column} has more than {MAX_EVENT_TYPES} values")
    return [r.t for r in rows]


def with_events(df: DataFrame, types: Sequence[str]) -> DataFrame:
    """Event flag and event type flags where the event columns exist; SNAP columns pass through."""
    added: dict[str, Column] = {}
    if "event_name_1" in df.columns:
        added["has_event"] = has_event()
    if "event_type_1" in df.columns:
        added |= event_type_flags(types)
    return df.withColumns(added) if added else df


def date_feature_names(include_cyclical: bool = False) -> list[str]:
    names = list(DATE_FEATURES)
    if include_cyclical:
        names += [f"{c}_{part}" for c in CYCLES for part in ("sin", "cos")]
    return names
