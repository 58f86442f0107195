"""Chronological train / validation / test split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larderflow.schemas import OUTSIDE, SPLITS


def with_split(
    df: DataFrame, train_end: str, val_end: str, test_end: str, date: str = "date", drop_rest: bool = True
) -> DataFrame:
    """Add ``split``. Rows after ``test_end`` and rows without a date belong to no split: they are dropped, or kept as
    ``outside`` with ``drop_rest=False``."""
    day = F.to_date(date)
    bounds = [F.lit(b).cast("date") for b in (train_end, val_end, test_end)]
    split = F.when(day <= bounds[0], SPLITS[0]).when(day <= bounds[1], SPLITS[1]).when(day <= bounds[2], SPLITS[2])
    if drop_rest:
        return df.withColumn("split", split).where(F.col("split").isNotNull())
    return df.withColumn("split", F.coalesce(split, F.lit(OUTSIDE)))


def split_report(df: DataFrame, date: str = "date") -> DataFrame:
    """Rows and date range of each split."""
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(date).alias("first_date"), F.max(date).alias("last_date")
    )


def check_no_leak(df: DataFrame, date: str = "date") -> DataFrame:
    """One row: whether every non-empty split ends before the next begins."""
    ends = {}
    for s in SPLITS:
        day = F.when(F.col("split") == s, F.col(date))
        ends |= {f"{s}_first": F.min(day), f"{s}_last": F.max(day)}
    spans = df.agg(*[expr.alias(name) for name, expr in ends.items()])

    def before(a: str, b: str):
        return F.coalesce(F.col(f"{a}_last") < F.col(f"{b}_first"), F.lit(True))

    ordered = before("train", "val") & before("val", "test") & before("train", "test")
    return spans.withColumn("ordered", ordered)


def assert_no_leak(df: DataFrame, date: str = "date") -> DataFrame:
    """``df`` itself, after a one-row check that the splits do not overlap."""
    if not check_no_leak(df, date).first()["ordered"]:
        raise ValueError("train, validation and test periods overlap")
    return df


def take_split(df: DataFrame, split: str) -> DataFrame:
    return df.where(F.col("split") == split)
