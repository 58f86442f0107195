"""Panels stored in buckets of series, so that work by series needs no shuffle.

A series lies whole in one bucket, sorted by date; one file per bucket. Lags, windows, running statistics and fills group by the
series (and a stretch of time), which the buckets already do. The stored order holds inside files; a task may read
several, so Spark still sorts within tasks, without moving rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from larderflow.schemas import SERIES

# Buckets are used even where rows are copied between scan and window, and joins by series and stretch of time settle for
# both sides lying together by series. The second holds for bucketed tables only: elsewhere it would put all
# stretches of a long series into one task.
CONF = {
    "spark.sql.sources.bucketing.enabled": "true",
    "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


def series_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose settings let operators by series use the buckets.

    The settings of ``spark`` itself stay as they are. Tables are shared by both.
    """
    own = spark.newSession()
    for key in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        value = spark.conf.get(key, None)
        if value is not None:
            own.conf.set(key, value)
    for key, value in CONF.items():
        own.conf.set(key, value)
    return own


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def write_bucketed(
    df: DataFrame, table: str, path: str, buckets: int, keys: Sequence[str] = SERIES, date: str = "date", mode: str = "errorifexists"
) -> None:
    """Write ``df`` to ``path`` as the table ``table``: ``buckets`` buckets of series, each one file sorted by series and date.

    Choose buckets so that one fits a task (total size over 128 MB or so); they bound how many tasks work side by side.
    """
    if buckets < 1:
        raise ValueError("buckets must be positive")
    rows = df.repartition(buckets, *keys)
    rows.write.mode(mode).bucketBy(buckets, *keys).sortBy(*keys, date).option("path", path).format("parquet").saveAsTable(table)


def open_bucketed(
    spark: SparkSession, table: str, path: str, buckets: int, keys: Sequence[str] = SERIES, date: str = "date"
) -> DataFrame:
    """The table that ``write_bucketed`` wrote to ``path``, also in an application whose catalog does not know it yet."""
    if not spark.catalog.tableExists(table):
        columns = ", ".join(f"{_quoted(f.name)} {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
        by, order = (", ".join(map(_quoted, names)) for names in (keys, (*keys, date)))
        location = path.replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE {_quoted(table)} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({order}) "
            f"INTO {int(buckets)} BUCKETS LOCATION '{location}'"
        )
    return spark.table(table)
