"""Registry of queries and their SQL, and tables derived once per session."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larderflow.session import fresh_path

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_STAGED: dict[tuple[str, str, str], str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; without ``sql`` only its rows are checked."""

    def register(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def staged_path(spark: SparkSession, sf_dir: str, label: str, write: Callable[[str], None]) -> str:
    """Where ``write`` has put what it derives from the supplied tables, once per session, in the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir, label)
    if key not in _STAGED:
        path = fresh_path(spark, label)
        write(path)
        _STAGED[key] = path
    return _STAGED[key]


def staged(spark: SparkSession, sf_dir: str, label: str, build: Query) -> DataFrame:
    """The table ``build`` derives from the supplied ones, written once per session to the shared folder.

    Later queries read the written table, as a production flow reads the output of its preparation step.
    """
    return spark.read.parquet(staged_path(spark, sf_dir, label, lambda path: build(spark, sf_dir).write.parquet(path)))
