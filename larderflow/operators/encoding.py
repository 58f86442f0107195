"""Label encoding with one vocabulary for all splits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larderflow.operators.ranks import category_codes, running_weight
from larderflow.schemas import CATEGORIES
from larderflow.session import path_exists

VOCABULARY = "column string, value string, code int, version int"


def fit_codes(df: DataFrame, columns: Sequence[str] = CATEGORIES) -> DataFrame:
    """Vocabulary ``(column, value, code)`` in text order; write it as a table to reuse it for later data."""
    return category_codes(df, [c for c in columns if c in df.columns])


def with_codes(
    df: DataFrame, columns: Sequence[str] = CATEGORIES, codes: DataFrame | None = None
) -> DataFrame:
    """Add ``{column}_encoded``; null and unseen values are -1."""
    columns = [c for c in columns if c in df.columns]
    codes = fit_codes(df, columns) if codes is None else codes
    # Codes are looked up once per distinct category tuple, so the facts are joined a single time.
    tuple_keys = [f"_k_{c}" for c in columns]
    tuples = df.select(*[F.col(c).alias(k) for c, k in zip(columns, tuple_keys)]).distinct()
    pairs = [
        F.struct(F.lit(c).alias("column"), F.col(k).cast("string").alias("value")) for c, k in zip(columns, tuple_keys)
    ]
    found = tuples.select(*tuple_keys, F.inline(F.array(*pairs))).join(codes, ["column", "value"], "left")
    encoded = found.groupBy(*tuple_keys).agg(
        *[
            F.coalesce(F.max(F.when(F.col("column") == c, F.col("code"))), F.lit(-1)).alias(f"{c}_encoded")
            for c in columns
        ]
    )
    same_tuple = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(columns, tuple_keys)])
    return df.join(encoded, same_tuple, "left").drop(*tuple_keys)


def new_codes(known: DataFrame, df: DataFrame, columns: Sequence[str] = CATEGORIES) -> DataFrame:
    """Values of ``df`` that ``known`` (column, value, code) lacks, as ``(column, value, code)``.

    They go on from the highest code of their column, in text order among themselves; codes given before never change.
    Distinct values are counted before anything is ordered, so no sort has the size of the facts.
    """
    columns = [c for c in columns if c in df.columns]
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    values = df.select(*columns).distinct().select(F.inline(F.array(*pairs))).where(F.col("value").isNotNull()).distinct()
    fresh = values.join(known.select("column", "value"), ["column", "value"], "left_anti")
    placed = running_weight(fresh.withColumn("_one", F.lit(1).cast("bigint")), ["column"], "value", "_one")
    used = known.groupBy("column").agg((F.max("code") + 1).alias("_used"))
    code = (F.coalesce("_used", F.lit(0)) + F.col("below")).cast("int")
    return placed.join(used, "column", "left").select("column", "value", code.alias("code"))


def update_codes(df: DataFrame, path: str, columns: Sequence[str] = CATEGORIES) -> DataFrame:
    """Give the new values of ``df`` codes and append just these to the vocabulary at ``path``, as its next version.

    The same values again add nothing. One writer at a time: two would give one code twice.
    """
    spark = df.sparkSession
    known = read_codes(spark, path) if path_exists(spark, path) else spark.createDataFrame([], VOCABULARY)
    last = known.agg(F.max("version")).first()[0]
    version = 0 if last is None else last + 1
    new_codes(known, df, columns).withColumn("version", F.lit(version)).write.mode("append").parquet(path)
    return read_codes(spark, path)


def read_codes(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The vocabulary as it is, or as it was at a version: a model keeps the codes it was fitted with."""
    codes = spark.read.schema(VOCABULARY).parquet(path)
    return codes if version is None else codes.where(F.col("version") <= version)
