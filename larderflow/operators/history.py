"""Lag, difference, rolling, expanding and ratio features of a series.

Steps are rows. ``gap_free=True`` states that a series has one row per day, which saves a shuffle; it is the layout
that melting and densifying produce. Frames include the current row unless ``exclude_current`` is set.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from larderflow.operators.series import BLOCK_ROWS, block_window, own_rows, time_chunk, with_blocks
from larderflow.schemas import SERIES
from larderflow.settings import FeatureSettings

STATISTICS = ("mean", "std", "min", "max", "sum")
RATIO_EPSILON = 1e-8
DEFAULT_WINDOWS = FeatureSettings().rolling_windows


def _statistic(name: str) -> None:
    if name not in STATISTICS:
        raise ValueError(f"unknown function: {name}; use one of {STATISTICS}")


def lag_columns(w: WindowSpec, target: str, periods: Sequence[int]) -> dict[str, Column]:
    return {f"lag_{k}": F.lag(target, k).over(w) for k in periods}


def diff_columns(w: WindowSpec, target: str, periods: Sequence[int]) -> dict[str, Column]:
    return {f"diff_{k}": F.col(target) - F.lag(target, k).over(w) for k in periods}


# What each statistic is made of: count, sum, squared deviation, smallest and largest value of a run of rows.
PARTS = {"mean": "ns", "sum": "ns", "std": "nsq", "min": "l", "max": "h"}
State = dict[str, str]


def _parts(functions: Sequence[str]) -> list[str]:
    used = "".join(PARTS[name] for name in functions)
    return [c for c in "nsqlh" if c in used]


def _merge(a: State, b: State) -> State:
    """SQL for two adjacent runs of rows taken together; a run before the series start is null and counts nothing."""
    out = {c: f"({a[c]} + coalesce({b[c]}, 0D))" for c in "ns" if c in a}
    if "q" in a:
        gap = f"(try_divide({a['s']}, {a['n']}) - try_divide({b['s']}, {b['n']}))"
        between = f"{gap} * {gap} * try_divide({a['n']} * {b['n']}, {out['n']})"
        out["q"] = f"({a['q']} + coalesce({b['q']}, 0D) + coalesce({between}, 0D))"
    if "l" in a:
        out["l"] = f"least({a['l']}, {b['l']})"
    if "h" in a:
        out["h"] = f"greatest({a['h']}, {b['h']})"
    return out


def _finish(state: State, name: str) -> str:
    if name == "mean":
        return f"try_divide({state['s']}, {state['n']})"
    if name == "sum":
        return f"if({state['n']} > 0, {state['s']}, null)"
    if name == "std":
        return f"if({state['n']} > 1, sqrt(try_divide({state['q']}, {state['n']} - 1)), null)"
    return state["l" if name == "min" else "h"]


def add_rolling(
    df: DataFrame,
    w: WindowSpec,
    target: str,
    windows: Sequence[tuple[int, Sequence[str]]] = DEFAULT_WINDOWS,
    exclude_current: bool = False,
) -> DataFrame:
    """Add ``rolling_{function}_{size}`` columns over the ordered window ``w``.

    Runs of 1, 2, 4, 8, ... rows are built by merging each run with the one before it, and every window is put together
    from few such runs. A row costs about log2(size) merges instead of size updates, and only rows of the window enter
    its result. All steps use the partitioning and order of ``w``, so there is still one shuffle and one sort.
    """
    for name in {name for _, functions in windows for name in functions}:
        _statistic(name)
    y = f"double(`{target}`)"
    start = {"n": f"if({y} is null, 0D, 1D)", "s": f"coalesce({y}, 0D)", "q": "0D", "l": y, "h": y}
    parts = _parts([name for _, functions in windows for name in functions])
    run = 1
    out = df.withColumns({f"_{c}1": F.expr(start[c]) for c in parts})
    while 2 * run <= max(size for size, _ in windows):
        lagged = out.withColumns({f"_p{c}": F.lag(f"_{c}{run}", run).over(w) for c in parts})
        merged = _merge({c: f"_{c}{run}" for c in parts}, {c: f"_p{c}" for c in parts})
        run *= 2
        out = lagged.withColumns({f"_{c}{run}": F.expr(v) for c, v in merged.items()})
    pieces: dict[str, Column] = {}
    results = {}
    for size, functions in windows:
        offset, left, total = int(exclude_current), size, None
        while left:
            length = 1 << (left.bit_length() - 1)
            piece = {c: f"_{c}{length}_{offset}" for c in _parts(functions)}
            pieces |= {name: F.lag(f"_{c}{length}", offset).over(w) for c, name in piece.items()}
            if total is None:
                total = {c: v if c in "lh" else f"coalesce({v}, 0D)" for c, v in piece.items()}
            else:
                total = _merge(total, piece)
            offset, left = offset + length, left - length
        results |= {f"rolling_{name}_{size}": _finish(total, name) for name in functions}
    final = [F.expr(sql).alias(name) for name, sql in results.items()]
    return out.withColumns(pieces).select(*df.columns, *final)


def price_change_column(w: WindowSpec, price: str = "sell_price", step: int = 7) -> dict[str, Column]:
    return {f"price_change_{step}": F.col(price) - F.lag(price, step).over(w)}


def with_series_columns(
    df: DataFrame,
    build: Mapping[str, Column],
    keys: Sequence[str],
    date: str,
    before: int,
    gap_free: bool,
) -> DataFrame:
    """Evaluate window columns over series blocks with ``before`` rows of history: one shuffle for all of them."""
    return own_rows(with_blocks(df, keys, date, before=before, gap_free=gap_free).withColumns(dict(build)))


def with_lags(
    df: DataFrame,
    target: str = "sales",
    periods: Sequence[int] = (1, 7, 14, 28),
    keys: Sequence[str] = SERIES,
    date: str = "date",
    gap_free: bool = False,
) -> DataFrame:
    columns = lag_columns(block_window(keys, date), target, periods)
    return with_series_columns(df, columns, keys, date, max(periods), gap_free)


def with_diffs(
    df: DataFrame,
    target: str = "sales",
    periods: Sequence[int] = (1, 7),
    keys: Sequence[str] = SERIES,
    date: str = "date",
    gap_free: bool = False,
) -> DataFrame:
    columns = diff_columns(block_window(keys, date), target, periods)
    return with_series_columns(df, columns, keys, date, max(periods), gap_free)


def with_rolling(
    df: DataFrame,
    target: str = "sales",
    windows: Sequence[tuple[int, Sequence[str]]] = DEFAULT_WINDOWS,
    keys: Sequence[str] = SERIES,
    date: str = "date",
    gap_free: bool = False,
    exclude_current: bool = False,
) -> DataFrame:
    """``rolling_{function}_{size}`` for each window; a single row has no ``std``."""
    reach = max(size for size, _ in windows)
    blocks = with_blocks(df, keys, date, before=reach, gap_free=gap_free)
    return own_rows(add_rolling(blocks, block_window(keys, date), target, windows, exclude_current))


def with_price_change(
    df: DataFrame,
    price: str = "sell_price",
    step: int = 7,
    keys: Sequence[str] = SERIES,
    date: str = "date",
    gap_free: bool = False,
) -> DataFrame:
    columns = price_change_column(block_window(keys, date), price, step)
    return with_series_columns(df, columns, keys, date, step, gap_free)


def with_ratios(df: DataFrame) -> DataFrame:
    """Short over long rolling mean, where both inputs exist."""
    pairs = {"ratio_7_28": ("rolling_mean_7", "rolling_mean_28"), "ratio_14_28": ("rolling_mean_14", "rolling_mean_28")}
    added = {
        name: F.col(short) / (F.col(long) + F.lit(RATIO_EPSILON))
        for name, (short, long) in pairs.items()
        if short in df.columns and long in df.columns
    }
    return df.withColumns(added) if added else df


def with_expanding(
    df: DataFrame,
    target: str = "sales",
    functions: Sequence[str] = ("mean", "std"),
    keys: Sequence[str] = SERIES,
    date: str = "date",
    days: int = BLOCK_ROWS,
) -> DataFrame:
    """``expanding_{function}`` over all rows up to the current one.

    Each time chunk is summarised to count, sum, squared deviation, min and max. The chunks before a row are merged with
    the rows of its own chunk, so no task scans a whole series. The join and the window share one shuffle.
    """
    for name in functions:
        _statistic(name)
    keys = list(keys)
    y = F.col(target).cast("double")
    chunked = df.withColumn("_chunk", time_chunk(date, days))
    parts = chunked.groupBy(*keys, "_chunk").agg(
        F.count(y).cast("double").alias("_n"),
        F.sum(y).alias("_s"),
        (F.var_pop(y) * F.count(y)).alias("_m2"),
        F.min(y).alias("_lo"),
        F.max(y).alias("_hi"),
    )
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    # Squared deviations of the earlier chunks around their common mean: inside chunks plus between chunks.
    n, s = F.sum("_n").over(earlier), F.sum("_s").over(earlier)
    between = F.sum(F.try_divide(F.col("_s") * F.col("_s"), F.col("_n"))).over(earlier) - F.try_divide(s * s, n)
    before = parts.select(
        *keys,
        "_chunk",
        F.coalesce(n, F.lit(0.0)).alias("_n0"),
        F.coalesce(s, F.lit(0.0)).alias("_s0"),
        F.coalesce(F.sum("_m2").over(earlier) + between, F.lit(0.0)).alias("_m0"),
        F.min("_lo").over(earlier).alias("_lo0"),
        F.max("_hi").over(earlier).alias("_hi0"),
    )
    here = Window.partitionBy(*keys, "_chunk").orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    running = chunked.join(before.hint("shuffle_hash"), [*keys, "_chunk"], "left").withColumns(
        {
            "_count": F.count(y).over(here),
            "_sum": F.sum(y).over(here),
            "_var": F.var_pop(y).over(here),
            "_lo1": F.min(y).over(here),
            "_hi1": F.max(y).over(here),
        }
    )
    local = running.withColumns(
        {
            "_n1": F.col("_count").cast("double"),
            "_s1": F.coalesce("_sum", F.lit(0.0)),
            "_m1": F.coalesce(F.col("_var") * F.col("_count"), F.lit(0.0)),
        }
    )
    n_all, s_all = F.col("_n0") + F.col("_n1"), F.col("_s0") + F.col("_s1")
    gap = F.coalesce(F.try_divide(F.col("_s1"), F.col("_n1")) - F.try_divide(F.col("_s0"), F.col("_n0")), F.lit(0.0))
    m2 = F.col("_m0") + F.col("_m1") + gap * gap * F.coalesce(
        F.try_divide(F.col("_n0") * F.col("_n1"), n_all), F.lit(0.0)
    )
    results = {
        "mean": F.try_divide(s_all, n_all),
        "std": F.when(n_all > 1, F.sqrt(F.greatest(m2, F.lit(0.0)) / (n_all - 1))),
        "min": F.least("_lo0", "_lo1"),
        "max": F.greatest("_hi0", "_hi1"),
        "sum": F.when(n_all > 0, s_all),
    }
    out = local.withColumns({f"expanding_{name}": results[name] for name in functions})
    return out.select(*df.columns, *[f"expanding_{name}" for name in functions])


def rolling_names(windows: Sequence[tuple[int, Sequence[str]]] = DEFAULT_WINDOWS) -> list[str]:
    return [f"rolling_{name}_{size}" for size, functions in windows for name in functions]


def lag_names(periods: Sequence[int] = (1, 7, 14, 28)) -> list[str]:
    return [f"lag_{k}" for k in periods]
