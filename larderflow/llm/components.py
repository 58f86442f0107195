"""Connected components of a link table by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larderflow.session import written


def _pointed(links: DataFrame) -> DataFrame:
    """Links as (u, v) with u > v, each once."""
    return (
        links.filter(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One step: every node's neighbours (large: its larger ones, small: its smaller ones) are tied to the least of them.

    The least neighbour is a minimum with partial aggregation and is joined back, so a node with very many links is
    never gathered in one task.
    """
    sides = links.select(F.col("u").alias("node"), F.col("v").alias("near"))
    if large:
        sides = sides.unionAll(links.select(F.col("v").alias("node"), F.col("u").alias("near")))
    least = sides.groupBy("node").agg(F.min("near").alias("least"))
    tied = sides.join(least, "node").select("node", "near", F.least("node", "least").alias("least"))
    if large:
        return tied.filter(F.col("near") > F.col("node")).select(F.col("near").alias("u"), F.col("least").alias("v"))
    return (
        tied.select(F.col("near").alias("u"), F.col("least").alias("v"))
        .unionAll(least.select(F.col("node").alias("u"), F.col("least").alias("v")))
    )


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (u, v long): component is the least node reachable.

    Nodes without links are absent, self links and repeated links count once, an empty table gives no rows. Each round
    ends in a table in the shared folder, which cuts the lineage and survives lost executors; the driver only sees one
    row of totals. The number of rounds grows with the logarithm of the longest chain.
    """
    state = written(_pointed(links), "links")
    before = None
    while True:
        total = state.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_003).alias("h")).first()
        if (total.n, total.h) == before or not total.n:
            break
        before = (total.n, total.h)
        state = written(_pointed(_star(_pointed(_star(state, True)), False)), "links")
    roots = state.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return roots.unionAll(state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
