"""History features of new days from a state table, without reading the history again.

For every series the state keeps the last values and prices that a lag or window can reach, and the running count, sum,
squared deviation, minimum and maximum. New days are joined with it; their features follow from these arrays, and the state
moves on. A day's work is one row per series however long the history is.

On disk: ``features/date=...`` and ``state/as_of=...`` below one path. Both are written by overwriting just the partitions of the
new days, and a run reads the newest state before its own days, so running a day again gives the same files.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larderflow.operators.history import with_ratios
from larderflow.operators.series import last_rows
from larderflow.schemas import SERIES
from larderflow.settings import FeatureSettings

PRICE_STEP = 7


@dataclass(frozen=True)
class HistoryFeatures:
    """Which features are kept up to date, and from which columns."""

    settings: FeatureSettings = FeatureSettings()
    keys: tuple[str, ...] = SERIES
    date: str = "date"
    target: str = "sales"
    price: str = "sell_price"
    exclude_current: bool = True

    @property
    def reach(self) -> int:
        s = self.settings
        windows = [size for size, _ in s.rolling_windows]
        return max([*s.lag_periods, *s.diff_periods, *windows, PRICE_STEP])


def initial_state(history: DataFrame, spec: HistoryFeatures = HistoryFeatures()) -> DataFrame:
    """The state after ``history``, read once: the newest rows of each series and its totals."""
    y = F.col(spec.target).cast("double")
    newest = last_rows(history.select(*spec.keys, spec.date, y.alias("_y"), F.col(spec.price).cast("double").alias("_p")), spec.keys, spec.date, spec.reach)
    held = newest.groupBy(*spec.keys).agg(F.sort_array(F.collect_list(F.struct(spec.date, "_y", "_p"))).alias("_rows"))
    totals = history.groupBy(*spec.keys).agg(
        F.count(y).cast("double").alias("n"),
        F.coalesce(F.sum(y), F.lit(0.0)).alias("total"),
        F.coalesce(F.var_pop(y) * F.count(y), F.lit(0.0)).alias("spread"),
        F.min(y).alias("low"),
        F.max(y).alias("high"),
    )
    arrays = {"last_values": F.col("_rows._y"), "last_prices": F.col("_rows._p")}
    return held.join(totals, list(spec.keys)).withColumns(arrays).drop("_rows").select(*_state_columns(spec))


def _state_columns(spec: HistoryFeatures) -> list[str]:
    return [*spec.keys, "last_values", "last_prices", "n", "total", "spread", "low", "high"]


def _summed(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _spread(values: Column, mean: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))


def _merged(values: Column) -> Column:
    """The running totals of the state together with more values (no nulls): struct of n, total, spread, low, high."""
    n = F.size(values).cast("double")
    s = _summed(values)
    mean = F.try_divide(s, n)
    gap = F.coalesce(mean - F.try_divide(F.col("total"), F.col("n")), F.lit(0.0))
    between = gap * gap * F.coalesce(F.try_divide(F.col("n") * n, F.col("n") + n), F.lit(0.0))
    return F.struct(
        (F.col("n") + n).alias("n"),
        (F.col("total") + s).alias("total"),
        (F.col("spread") + F.when(n > 0, _spread(values, mean)).otherwise(0.0) + between).alias("spread"),
        F.least("low", F.array_min(values)).alias("low"),
        F.greatest("high", F.array_max(values)).alias("high"),
    )


def _before(values: str, steps: int) -> Column:
    """The entry ``steps`` rows before the row at ``_at`` (from 1), null before the start."""
    return F.when(F.col("_at") > steps, F.try_element_at(values, F.col("_at") - steps))


def _rolling(name: str, part: Column) -> Column:
    n = F.size(part)
    mean = _summed(part) / n
    found = {
        "mean": F.when(n > 0, mean), "sum": F.when(n > 0, _summed(part)), "min": F.array_min(part), "max": F.array_max(part),
        "std": F.when(n > 1, F.sqrt(_spread(part, mean) / (n - 1))),
    }
    if name not in found:
        raise ValueError(f"unknown function: {name}; use one of {sorted(found)}")
    return found[name]


def advance(state: DataFrame, new: DataFrame, spec: HistoryFeatures = HistoryFeatures()) -> tuple[DataFrame, DataFrame]:
    """Features of ``new`` rows (days after those of the state, in any number) and the state after them.

    Series without a state begin with their first row; series without new rows keep their state. Steps are rows, as
    in the full build. A series' new rows are held as one array, so hand over days, not years.
    """
    keys, reach = list(spec.keys), spec.reach
    row = F.struct(spec.date, F.struct(*[c for c in new.columns if c not in (*keys, spec.date)]).alias("row"))
    grouped = new.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("_new"))
    empty = F.array().cast("array<double>")
    both = grouped.join(state, keys, "full").withColumns(
        {
            "_new": F.coalesce("_new", F.array().cast(grouped.schema["_new"].dataType)),
            "last_values": F.coalesce("last_values", empty), "last_prices": F.coalesce("last_prices", empty),
            **{c: F.coalesce(c, F.lit(0.0)) for c in ("n", "total", "spread")},
        }
    )
    both = both.withColumn("_y", F.transform(F.col("_new"), lambda x: x.row[spec.target].cast("double")))
    both = both.withColumn("_all", F.concat("last_values", "_y"))
    both = both.withColumn("_prices", F.concat("last_prices", F.transform(F.col("_new"), lambda x: x.row[spec.price].cast("double"))))
    present = lambda values: F.filter(values, lambda x: x.isNotNull())
    kept = lambda values: F.slice(values, F.greatest(F.lit(1), F.size(values) - reach + 1), reach)
    after = both.withColumn("_t", _merged(present(F.col("_y"))))
    after = after.select(*keys, kept(F.col("_all")).alias("last_values"), kept(F.col("_prices")).alias("last_prices"), "_t.*")

    rows = both.select(*keys, "last_values", "_y", "_all", "_prices", "n", "total", "spread", "low", "high", F.posexplode("_new").alias("_k", "_one"))
    rows = rows.withColumn("_at", F.size("last_values") + F.col("_k") + 1)
    rows = rows.withColumn("_t", _merged(present(F.slice("_y", F.lit(1), F.col("_k") + 1))))
    s = spec.settings
    y = F.try_element_at("_all", F.col("_at"))
    columns = {f"lag_{k}": _before("_all", k) for k in s.lag_periods}
    columns |= {f"diff_{k}": y - _before("_all", k) for k in s.diff_periods}
    columns[f"price_change_{PRICE_STEP}"] = F.try_element_at("_prices", F.col("_at")) - _before("_prices", PRICE_STEP)
    last = F.col("_at") - int(spec.exclude_current)
    for size, functions in s.rolling_windows:
        first = F.greatest(F.lit(1), last - size + 1)
        part = present(F.when(last > 0, F.slice("_all", first, last - first + 1)).otherwise(F.array().cast("array<double>")))
        rows = rows.withColumn(f"_w{size}", part)
        columns |= {f"rolling_{name}_{size}": _rolling(name, F.col(f"_w{size}")) for name in functions}
    columns["expanding_mean"] = F.try_divide(F.col("_t.total"), F.col("_t.n"))
    columns["expanding_std"] = F.when(F.col("_t.n") > 1, F.sqrt(F.col("_t.spread") / (F.col("_t.n") - 1)))
    features = rows.select(*keys, f"_one.{spec.date}", "_one.row.*", *[c.alias(n) for n, c in columns.items()])
    return with_ratios(features), after.select(*_state_columns(spec))


def _newest(spark: SparkSession, path: str) -> list[str]:
    """The days of which there is a state, oldest first."""
    try:
        found = spark.read.parquet(f"{path}/state").select("as_of").distinct().collect()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted(str(r.as_of) for r in found)


def _overwrite(df: DataFrame, path: str, by: str) -> None:
    df.write.option("partitionOverwriteMode", "dynamic").partitionBy(by).mode("overwrite").parquet(path)


def start(history: DataFrame, path: str, spec: HistoryFeatures = HistoryFeatures()) -> None:
    """Write the state after ``history``."""
    as_of = history.agg(F.max(spec.date).cast("string")).first()[0]
    _overwrite(initial_state(history, spec).withColumn("as_of", F.lit(as_of)), f"{path}/state", "as_of")


def update(new: DataFrame, path: str, spec: HistoryFeatures = HistoryFeatures()) -> DataFrame:
    """Write features of the new days and the state after them; the features written, read back.

    The last days may be run again. Days before others that are built already are refused: their successors would keep
    features of the old values, so run from that day on.
    """
    spark = new.sparkSession
    span = new.agg(F.min(spec.date).cast("string").alias("first"), F.max(spec.date).cast("string").alias("last")).first()
    if span.first is None:
        raise ValueError("there are no new days")
    built = _newest(spark, path)
    if built and built[-1] > span.last:
        raise ValueError(f"days up to {built[-1]} are built; update from {span.first} up to there")
    earlier = [day for day in built if day < span.first]
    if earlier:
        state = spark.read.parquet(f"{path}/state").where(F.col("as_of").cast("string") == earlier[-1]).select(*_state_columns(spec))
    else:
        state = initial_state(new.limit(0), spec)
    features, after = advance(state, new, spec)
    _overwrite(features, f"{path}/features", spec.date)
    _overwrite(after.withColumn("as_of", F.lit(span.last)), f"{path}/state", "as_of")
    return spark.read.parquet(f"{path}/features").where(F.col(spec.date).between(span.first, span.last))
