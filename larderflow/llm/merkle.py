"""A Merkle manifest of a table: one tree of 8-ary hashes for each group, one tree over the roots of the groups.

Leaves are put in order by a range shuffle of narrow rows (digests, not texts); a leaf's place follows from its row in its
sorted partition and the counts of the partitions before. Aligned builders then take 512 neighbouring nodes each, and
append their nodes to a log in the order of their completion (postorder): a node is written as soon as its last child is.
The tops of 512 such segments are the nodes of the next tier, until one is left, so no task holds more than 512 nodes and
what they stand for. Where a node lies in the log needs no index: the sizes of the subtrees that are complete before it give
its position in closed form (``log_position``), and proofs read the siblings of each level from those positions.

Rows with a null group form a group of their own, before all others; groups are ordered by their UTF-8 bytes. Null ids come
first. Rows of equal id follow each other by digest, so repeated rows need no further order; they are dealt over partitions
by their row number, so a third of all rows may be equal. Empty and very long texts are fields like any other. Other columns
are not looked at, whatever their names. An empty table has no proofs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larderflow.session import written

FAN = 8
# Levels that one builder adds: it takes FAN ** RAISED nodes.
RAISED = 3
SEGMENT = FAN**RAISED
# An id of a row number: the partition in the upper bits, the row in it in the lower 33.
ROW_BITS = 33
PATH = "siblings binary, before array<int>, after array<int>, subroot string, root string"


@dataclass(frozen=True)
class Manifest:
    """The log in segments, one table per tier from the leaves up, for the groups and for the tree over their roots."""

    groups: list[DataFrame]
    top: list[DataFrame]


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field_text(value: Column | str) -> Column:
    """A field as hashed: its bytes are counted, so no two rows give the same text; a null is a single sign."""
    said = (F.col(value) if isinstance(value, str) else value).cast("string")
    return F.coalesce(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said), F.lit("-"))


def leaf_digest(*fields: Column | str) -> Column:
    return F.sha2(F.concat(*map(field_text, fields)), 256)


def level_sizes(n: int, levels: int | None = None) -> list[int]:
    """Nodes of each level over ``n`` nodes: ``levels`` more levels, or as many as lead to one node."""
    sizes = [n]
    while len(sizes) <= levels if levels is not None else sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // FAN))
    return sizes


def log_position(level: int, place: int, n: int, height: int) -> int:
    """Position of a node in the postorder log of a tree of ``n`` leaves and ``height`` levels above them.

    What was complete before it: on its own and lower levels all nodes up to its last leaf, on higher levels the nodes that
    end before its first leaf.
    """
    start, end = place * FAN**level, min((place + 1) * FAN**level, n)
    lower = sum(-(-end // FAN**k) for k in range(level + 1))
    return lower - 1 + sum(start // FAN**k for k in range(level + 1, height + 1))


def append_log(nodes: Sequence[str], levels: int) -> list[tuple[int, str]]:
    """(level, digest) of nodes and of what is built on them, in the order of completion; the top comes last."""
    log: list[tuple[int, str]] = []
    waiting: list[list[str]] = [[] for _ in range(levels)]
    for k, node in enumerate(nodes):
        last = k == len(nodes) - 1
        log.append((0, node))
        for level in range(levels):
            waiting[level].append(node)
            if len(waiting[level]) < FAN and not last:
                break
            node = digest("".join(waiting[level]))
            waiting[level].clear()
            log.append((level + 1, node))
    return log


def segment_paths(log: Sequence[str], n: int, levels: int) -> Iterator[tuple[bytes, list[int], list[int]]]:
    """For each of the ``n`` lowest nodes of a segment: all siblings up to its top, and how many stand before and after."""
    sizes = level_sizes(n, levels)
    rows = [[log[log_position(level, k, n, levels)].encode() for k in range(sizes[level])] for level in range(levels)]
    for place in range(n):
        siblings, before, after = [], [], []
        for level, row in enumerate(rows):
            at = place // FAN**level
            start = at - at % FAN
            stop = min(start + FAN, len(row))
            siblings += [*row[start:at], *row[at + 1 : stop]]
            before.append(at - start)
            after.append(stop - at - 1)
        yield b"".join(siblings), before, after


def _raised(n: int) -> int:
    return min(RAISED, len(level_sizes(n)) - 1)


def _ordered(leaves: DataFrame) -> tuple[DataFrame, int]:
    """``leaves`` (tree, id, leaf, claimed) with ``place`` in the tree and ``size`` of the tree, and the largest size."""
    order = ["tree", "id", "leaf", "_salt"]
    salted = written(leaves.withColumn("_salt", F.monotonically_increasing_id()), "leaves")
    ranged = salted.repartitionByRange(*order).sortWithinPartitions(*order).drop("_salt")
    rows = written(ranged.withColumn("_row", F.monotonically_increasing_id()), "ordered")
    rows = rows.withColumn("_part", F.shiftrightunsigned("_row", ROW_BITS))
    runs = rows.groupBy("tree", "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy("tree")
    earlier = F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("tree", "_part", (F.coalesce(earlier, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("size"))
    placed = rows.join(runs, ["tree", "_part"]).withColumn("place", F.col("_row") + F.col("_shift"))
    most = runs.agg(F.max("size").alias("n")).first().n or 0
    return placed.withColumn("leaves", F.col("size")).drop("_row", "_part", "_shift"), most


def _list(values: pa.Array | pa.ChunkedArray) -> pa.ListArray:
    """All values as the list of a single row."""
    whole = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    return pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), whole)


def _built(nodes: DataFrame, tier: int) -> DataFrame:
    """One segment for each run of ``SEGMENT`` neighbouring nodes (tree, place, size, leaves, id, leaf, claimed) of a tree.

    ``positions`` are those in the log of the whole tree; null for nodes that are in the log of the tier below already.
    """
    kind = nodes.schema["id"].dataType.simpleString()

    def build(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        block, size, leaves = key[1].as_py(), table.column("size")[0].as_py(), table.column("leaves")[0].as_py()
        levels, height = _raised(size), len(level_sizes(leaves)) - 1
        log = append_log(table.column("leaf").to_pylist(), levels)
        written, positions = [0] * (levels + 1), []
        for level, _ in log:
            place = block * FAN ** (RAISED - level) + written[level]
            positions.append(None if tier and not level else log_position(RAISED * tier + level, place, leaves, height))
            written[level] += 1
        one = {"tree": key[0].as_py(), "block": block, "size": size, "leaves": leaves, "levels": levels, "top": log[-1][1]}
        lists = {"ids": table.column("id"), "claims": table.column("claimed")}
        lists |= {"log": pa.array([node for _, node in log]), "positions": pa.array(positions, pa.int64())}
        return pa.table([pa.array([v]) for v in one.values()] + [_list(v) for v in lists.values()], [*one, *lists])

    schema = (
        "tree string, block long, size long, leaves long, levels long, top string, "
        f"ids array<{kind}>, claims array<string>, log array<string>, positions array<long>"
    )
    return nodes.groupBy("tree", F.floor(F.col("place") / SEGMENT).alias("block")).applyInArrow(build, schema)


def _tiers(leaves: DataFrame) -> list[DataFrame]:
    """The segments of all tiers; every tree has the same number of tiers, a finished one repeats its root."""
    nodes, most = _ordered(leaves)
    tiers = [written(_built(nodes, 0), "segments")]
    while most > SEGMENT:
        most = -(-most // SEGMENT)
        below = tiers[-1]
        nodes = below.select(
            "tree", F.col("block").alias("place"), F.ceil(F.col("size") / SEGMENT).alias("size"), "leaves",
            F.col("block").alias("id"), F.col("top").alias("leaf"), F.lit(None).cast("string").alias("claimed"),
        )
        tiers.append(written(_built(nodes, len(tiers)), "segments"))
    return tiers


def build(leaves: DataFrame) -> Manifest:
    """The manifest of ``leaves``: ``group`` (string), ``id``, ``leaf`` (a hex digest) and ``claimed``.

    ``claimed`` is the digest of the row as found later; it goes along with the leaf to its proof and enters no node.
    """
    tree = F.coalesce(F.concat(F.lit("="), "group"), F.lit(""))  # the null group first, and apart from the empty one
    groups = _tiers(leaves.select(tree.alias("tree"), "id", "leaf", "claimed"))
    roots = groups[-1].select(F.lit("").alias("tree"), F.col("tree").alias("id"), F.col("top").alias("leaf"), F.lit(None).cast("string").alias("claimed"))
    return Manifest(groups, _tiers(roots))


def _paths(segments: DataFrame, above: DataFrame, leaves: bool) -> DataFrame:
    """The path to the root of each node of ``segments``, from the paths of their tops."""
    kind = segments.schema["ids"].dataType.elementType.simpleString()

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                row = {name: batch.column(i)[k] for i, name in enumerate(batch.schema.names)}
                one = {name: row[name].as_py() for name in ("tree", "block", "levels", "siblings", "before", "after", "subroot", "root")}
                ids, log = row["ids"].values, row["log"].as_py()
                n = len(ids)
                found = list(segment_paths(log, n, one["levels"]))
                columns = {
                    "tree": pa.array([one["tree"]] * n), "block": pa.array(range(one["block"] * SEGMENT, one["block"] * SEGMENT + n), pa.int64()),
                    "siblings": pa.array([f[0] + one["siblings"] for f in found], pa.binary()),
                    "before": pa.array([f[1] + one["before"] for f in found], pa.list_(pa.int32())),
                    "after": pa.array([f[2] + one["after"] for f in found], pa.list_(pa.int32())),
                    "subroot": pa.array([one["subroot"]] * n), "root": pa.array([one["root"]] * n),
                }
                if leaves:
                    own = [log[log_position(0, i, n, one["levels"])] for i in range(n)]
                    columns |= {"id": ids, "leaf": pa.array(own), "claimed": row["claims"].values}
                yield pa.record_batch(list(columns.values()), list(columns))

    schema = f"tree string, block long, {PATH}" + (f", id {kind}, leaf string, claimed string" if leaves else "")
    joined = segments.select("tree", "block", "levels", "ids", "claims", "log").join(above, ["tree", "block"])
    return joined.mapInArrow(extend, schema)


def proofs(manifest: Manifest) -> DataFrame:
    """One row per leaf: ``tree``, ``block`` (its place), ``id``, ``leaf``, ``claimed``, ``siblings`` (hex digests of all levels up to the
    root in one piece), ``before`` and ``after`` (siblings on either side, level by level), ``subroot`` and ``root``."""

    def down(tiers: list[DataFrame], above: DataFrame) -> DataFrame:
        for k in range(len(tiers) - 1, -1, -1):
            above = _paths(tiers[k], above, leaves=k == 0)
        return above

    nothing = [F.lit(b"").alias("siblings")] + [F.array().cast("array<int>").alias(c) for c in ("before", "after")]
    root = manifest.top[-1].select("tree", "block", *nothing, F.col("top").alias("subroot"), F.col("top").alias("root"))
    groups = down(manifest.top, root).select(
        F.col("id").alias("tree"), F.lit(0).cast("long").alias("block"), "siblings", "before", "after", F.col("leaf").alias("subroot"), "root"
    )
    return down(manifest.groups, groups)


def folded(leaf: Column | str, siblings: str = "siblings", before: str = "before", after: str = "after") -> Column:
    """The root that follows from a leaf and its siblings."""
    width = 64
    leaf = F.col(leaf) if isinstance(leaf, str) else leaf
    start = F.struct(F.lit(1).alias("at"), leaf.alias("digest"))

    def step(held: Column, run: Column) -> Column:
        left, right = width * run[before], width * run[after]
        said = F.concat(
            F.substr(siblings, held.at, left), held.digest.cast("binary"), F.substr(siblings, held.at + left, right)
        )
        return F.struct((held.at + left + right).alias("at"), F.sha2(said, 256).alias("digest"))

    return F.aggregate(F.arrays_zip(before, after), start, step, lambda held: held.digest)


def log(manifest: Manifest) -> DataFrame:
    """The whole log of the groups' trees: (tree, position, digest), one row per node."""
    segments = reduce(DataFrame.unionByName, manifest.groups)
    nodes = segments.select("tree", F.explode(F.arrays_zip("positions", "log")).alias("node"))
    return nodes.select("tree", F.col("node.positions").alias("position"), F.col("node.log").alias("digest")).filter("position IS NOT NULL")
