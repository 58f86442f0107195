"""Time blocks of long series.

Row windows over a series are cut into blocks of ``block`` rows. Rows near a block edge are copied into the neighbour as
halo, so every frame is complete inside one block and a window task never holds more than ``block`` rows plus halo of
one series, however long or hot that series is. ``(keys, date)`` must be unique, as in every demand panel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK_ROWS = 1024


def time_chunk(date: str, days: int = BLOCK_ROWS) -> Column:
    """Number of the fixed calendar span of ``days`` days that holds ``date``."""
    return F.floor(F.unix_date(F.to_date(date)) / F.lit(days)).cast("int")


def row_positions(df: DataFrame, keys: Sequence[str], date: str, days: int = BLOCK_ROWS) -> DataFrame:
    """Add ``_pos``, the 0-based position of each row in its series.

    Rows are counted per (series, calendar span) first; the running total of those few counts shifts the local row
    number, so no task sorts a whole series. The counts grow with the number of series, so they are not broadcast; the
    hash join uses the shuffle the row number needs anyway.
    """
    keys = list(keys)
    chunked = df.withColumn("_chunk", time_chunk(date, days))
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        chunked.groupBy(*keys, "_chunk")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, "_chunk", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    )
    local = F.row_number().over(Window.partitionBy(*keys, "_chunk").orderBy(date))
    return (
        chunked.join(offsets.hint("shuffle_hash"), [*keys, "_chunk"], "left")
        .withColumn("_pos", F.coalesce("_before", F.lit(0)) + local - 1)
        .drop("_chunk", "_before")
    )


def with_blocks(
    df: DataFrame,
    keys: Sequence[str],
    date: str,
    before: int = 0,
    after: int = 0,
    gap_free: bool = False,
    block: int = BLOCK_ROWS,
) -> DataFrame:
    """Add ``_block`` and ``_own``; rows with ``_own = false`` are halo copies to be dropped after the windows.

    On a gap-free daily panel one row is one day, so the block follows from the date without a shuffle. Otherwise
    positions are counted first, which keeps the row meaning of the frames exact.
    """
    block = max(block, before, after)
    if gap_free:
        placed = df.withColumn("_pos", F.unix_date(F.to_date(date)))
    else:
        placed = row_positions(df, keys, date, block)
    home = F.floor(F.col("_pos") / F.lit(block)).cast("int")
    offset = F.pmod(F.col("_pos"), F.lit(block))
    if not before and not after:
        return placed.withColumn("_block", home).withColumn("_own", F.lit(True)).drop("_pos")
    at_end, at_start = offset >= block - before, offset < after
    here, to_next, to_previous = F.lit(0), F.lit(1), F.lit(-1)
    copies = (
        F.when(at_end & at_start, F.array(here, to_next, to_previous))
        .when(at_end, F.array(here, to_next))
        .when(at_start, F.array(here, to_previous))
        .otherwise(F.array(here))
    )
    return (
        placed.withColumn("_shift", F.explode(copies))
        .withColumn("_block", home + F.col("_shift"))
        .withColumn("_own", F.col("_shift") == 0)
        .drop("_pos", "_shift")
    )


def block_window(keys: Sequence[str], date: str) -> WindowSpec:
    """Ordered window over one block of one series."""
    return Window.partitionBy(*keys, "_block").orderBy(date)


def own_rows(df: DataFrame) -> DataFrame:
    """Drop halo copies and the helper columns."""
    return df.where("_own").drop("_own", "_block")


def last_rows(df: DataFrame, keys: Sequence[str], date: str, n: int) -> DataFrame:
    """The last ``n`` rows of every series with ``_from_end`` = 1 for the newest.

    The rank filter runs as a group limit before the shuffle, so a task sends at most ``n`` rows per series.
    """
    newest = Window.partitionBy(*keys).orderBy(F.col(date).desc())
    return df.withColumn("_from_end", F.row_number().over(newest)).where(F.col("_from_end") <= n)
