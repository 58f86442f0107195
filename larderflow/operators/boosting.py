"""Gradient-boosted trees on the feature table, with missing values and column sampling by tree.

Values are put into at most 255 bins per feature once, missing ones into a bin of their own, and written as one byte each, in
blocks of rows.
Trees then grow level by level: every task adds up gradients and rows by (node, feature, bin) for its rows, one grouping adds
these bounded tables up, and the best split of each node, with the side that rows without the feature go to, is found from
them; the driver sees one row per node. A node of at most ``local_rows`` rows is finished by one task. Gradients are rounded
to whole numbers of a small unit, so their sums, and with them the trees, are the same however rows are dealt over tasks.

Squared error, a second-order gain with ``reg_lambda``, rows sampled by a hash of the row, columns by a seeded choice.
"""

from __future__ import annotations

import json
import random
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, replace
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larderflow.operators import trees
from larderflow.operators.trees import BINS, Split, Tree
from larderflow.schemas import IDENTIFIERS
from larderflow.session import discard, written
from larderflow.settings import BoostingSettings

NUMERIC = {"tinyint", "smallint", "int", "bigint", "float", "double"}
# Trees after which the sums of all trees so far are written beside the rows, and the validation errors are taken.
REFRESH = 10
# A gradient is at most this many units.
UNITS = 1 << 30
# Rows lie in blocks: a pass over them takes a few large cells, not one by one what belongs to each row.
BLOCK = "key binary, y binary, held_out binary, margin binary, bins binary"
DEALT = "slot int, g binary, bins binary"
NODE = "node int, left int, feature int, bin int, missing_left boolean, gain double, left_g double, left_n long, right_g double, right_n long"


class NotFitted(ValueError):
    """Prediction or importance asked from a missing model."""


@dataclass(frozen=True)
class BoostedTrees:
    """A fitted model: ``base`` plus the values of the leaves that a row comes to. ``n_rows`` were trained on;
    ``n_without_target`` rows had no target and were left out. ``errors``: root mean square on validation rows after each tree."""

    features: list[str]
    base: float
    trees: list[Tree]
    n_rows: int = 0
    n_without_target: int = 0
    errors: tuple[float, ...] = ()

    @cached_property
    def held(self) -> list[tuple[dict[str, np.ndarray], int]]:
        return [(t.arrays(), t.depth) for t in self.trees]

    def scores(self, values: np.ndarray) -> np.ndarray:
        """Predictions for rows of feature values; NaN is missing."""
        return trees.scores(self.base, self.held, values)


def numeric_features(df: DataFrame, target: str = "sales", exclude: Sequence[str] = IDENTIFIERS) -> list[str]:
    """All numeric columns but the target and the identifiers."""
    left_out = {target, *exclude}
    return [name for name, kind in df.dtypes if kind in NUMERIC and name not in left_out]


def _value(name: str) -> Column:
    """A feature as a double; undefined values are missing."""
    x = F.col(name).cast("double")
    return F.when(~F.isnan(x), x)


def bin_edges(df: DataFrame, features: Sequence[str], n_bins: int = BINS - 1) -> dict[str, list[float]]:
    """Upper edges of the bins of each feature, without the last: all its values if they are few, else quantiles."""
    counted = df.agg(*[F.approx_count_distinct(_value(c)).alias(c) for c in features]).first()
    few = [c for c in features if counted[c] <= n_bins]
    edges: dict[str, list[float]] = {}
    if few:  # the estimate bounds the sets, up to its error
        sets = df.agg(*[F.sort_array(F.collect_set(_value(c))).alias(c) for c in few]).first()
        edges = {c: sets[c][:-1] for c in few if len(sets[c]) <= n_bins}
    many = [c for c in features if c not in edges]
    if many:
        steps = [k / n_bins for k in range(1, n_bins)]
        cuts = df.agg(*[F.percentile_approx(_value(c), steps, 10 * n_bins).alias(c) for c in many]).first()
        edges |= {c: sorted(set(cuts[c] or [])) for c in many}
    return edges


def _binned(df: DataFrame, features: Sequence[str], target: str, edges: dict[str, list[float]], base: float) -> DataFrame:
    """One row per block of rows: what ``_Block`` holds of each, one byte per feature and row."""
    cuts = [np.array(edges[c]) for c in features]
    values = [_value(c).alias(f"_x{k}") for k, c in enumerate(features)]
    narrow = df.select(F.xxhash64(*df.columns).alias("key"), F.col(target).cast("double").alias("y"), "_held_out", *values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((len(cuts), len(batch)), np.uint8)
            for k, edge in enumerate(cuts):
                x = pc.fill_null(batch.column(k + 3), float("nan")).to_numpy(zero_copy_only=False)
                out[k] = np.where(np.isnan(x), 0, np.searchsorted(edge, x, "left") + 1)
            key, y, held_out = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:3])
            block = _Block(key, y, held_out.astype(bool), np.full(len(batch), base), out)
            yield _packed([tuple(x.tobytes() for x in block)], BLOCK)

    return narrow.mapInArrow(run, BLOCK)


class _Block(NamedTuple):
    """Some rows as arrays; ``bins`` by (feature, row)."""

    key: np.ndarray
    y: np.ndarray
    held_out: np.ndarray
    margin: np.ndarray
    bins: np.ndarray


def _packed(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Rows of whole numbers and bytes as a batch."""
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    names, types = zip(*[part.split() for part in schema.split(", ")], strict=True)
    return pa.record_batch([pa.array([r[k] for r in rows], kinds[t]) for k, t in enumerate(types)], list(names))


def _array(cell: pa.BinaryScalar, kind: type) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), kind)


def _blocks(batch: pa.RecordBatch) -> Iterator[_Block]:
    for cells in zip(*batch.columns, strict=True):
        key, y, held_out, margin, bins = (_array(c, kind) for c, kind in zip(cells, (np.int64, float, bool, float, np.uint8), strict=True))
        yield _Block(key, y, held_out, margin, bins.reshape(-1, len(key)))


def _sampled(keys: np.ndarray, seed: int, share: float) -> np.ndarray:
    """Which rows a tree sees: by a hash of the row and the tree's seed."""
    x = keys.astype(np.uint64) ^ np.uint64(seed)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) < share * 2.0**53


@dataclass(frozen=True)
class _Round:
    """What a task needs to know of the tree that grows: trees since the margins were written, its columns and sample."""

    since: list[tuple[dict[str, np.ndarray], int]]
    columns: list[int]
    seed: int
    settings: BoostingSettings
    scale: float

    def gradients(self, block: _Block) -> tuple[np.ndarray, np.ndarray]:
        """Bins and gradients (prediction less target) of the rows the tree sees."""
        rows = np.flatnonzero(~block.held_out & _sampled(block.key, self.seed, self.settings.subsample))
        bins, margin = block.bins[:, rows], block.margin[rows]
        for tree, depth in self.since:
            margin += tree["value"][trees.placed(tree, bins, depth, binned=True)]
        return bins, margin - block.y[rows]

    def units(self, gradients: np.ndarray) -> np.ndarray:
        return np.clip(np.rint(gradients * self.scale), -UNITS, UNITS)


def _searched(table: DataFrame, now: _Round, tree: Tree, nodes: list[int]) -> dict[int, Split | None]:
    """The best split of each of ``nodes``, from histograms added up over all tasks."""
    held, depth, slot_of = tree.arrays(), tree.depth, np.full(len(tree.left), -1)
    slot_of[nodes] = np.arange(len(nodes))
    width, columns, s, scale = len(now.columns), now.columns, now.settings, now.scale

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, counts = (np.zeros((len(nodes), width, BINS), np.int64) for _ in range(2))
        for block in (block for batch in batches for block in _blocks(batch)):
            bins, gradients = now.gradients(block)
            slots = slot_of[trees.placed(held, bins, depth, binned=True)]
            inside = slots >= 0
            sums, n = trees.histogram([bins[c][inside] for c in columns], slots[inside], now.units(gradients[inside]), len(nodes))
            totals += sums.astype(np.int64)
            counts += n
        slot, feature, bin = np.nonzero(counts)
        cells = [slot.astype(np.int32), (feature * BINS + bin).astype(np.int32), totals[slot, feature, bin], counts[slot, feature, bin]]
        yield pa.record_batch([pa.array(c) for c in cells], ["slot", "cell", "g", "n"])

    def best(key: tuple, cells: pa.Table) -> pa.Table:
        at = cells.column("cell").to_numpy()
        sums, counts = np.zeros(width * BINS), np.zeros(width * BINS, np.int64)
        sums[at], counts[at] = cells.column("g").to_numpy() / scale, cells.column("n").to_numpy()
        split = trees.best_splits(sums.reshape(1, width, BINS), counts.reshape(1, width, BINS), s.reg_lambda, s.min_child_weight)[0]
        return _node_table([(key[0].as_py(), 0, split)] if split else [])

    parts = table.mapInArrow(add, "slot int, cell int, g long, n long")
    cells = parts.groupBy("slot", "cell").agg(F.sum("g").alias("g"), F.sum("n").alias("n"))
    rows = cells.groupBy("slot").applyInArrow(best, NODE).collect()
    return dict.fromkeys(nodes) | {nodes[r.node]: _split_of(r) for r in rows}


def _node_table(found: list[tuple]) -> pa.Table:
    columns = list(zip(*[(n, c, s.feature, s.bin, s.missing_left, s.gain, *s.left, *s.right) for n, c, s in found], strict=True)) or [()] * 10
    kinds = [pa.int32()] * 4 + [pa.bool_(), pa.float64(), pa.float64(), pa.int64(), pa.float64(), pa.int64()]
    names = [part.split()[0] for part in NODE.split(", ")]
    return pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)


def _split_of(row) -> Split:
    return Split(row.feature, row.bin, row.missing_left, row.gain, (row.left_g, row.left_n), (row.right_g, row.right_n))


def _finished(table: DataFrame, now: _Round, tree: Tree, nodes: dict[int, int]) -> dict[int, list[tuple[int, int, Split]]]:
    """The whole subtrees of small ``nodes`` (with the levels left to them): each node's rows go to one task."""
    held, depth, slots = tree.arrays(), tree.depth, list(nodes)
    slot_of = np.full(len(tree.left), -1)
    slot_of[slots] = np.arange(len(slots))
    levels, columns, s, scale = list(nodes.values()), now.columns, now.settings, now.scale

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in (block for batch in batches for block in _blocks(batch)):
            bins, gradients = now.gradients(block)
            slot = slot_of[trees.placed(held, bins, depth, binned=True)]
            own, units = bins[columns], now.units(gradients).astype(np.int64)
            parts = [(k, np.flatnonzero(slot == k)) for k in np.unique(slot[slot >= 0]).tolist()]
            if parts:
                yield _packed([(k, units[rows].tobytes(), own[:, rows].tobytes()) for k, rows in parts], DEALT)

    def grow(key: tuple, parts: pa.Table) -> pa.Table:
        slot = key[0].as_py()
        units = [_array(c, np.int64) for c in parts.column("g")]
        bins = [_array(c, np.uint8).reshape(len(columns), -1) for c in parts.column("bins")]
        found = trees.grown(np.concatenate(bins, 1), np.concatenate(units), levels[slot], s.reg_lambda, s.min_child_weight, scale)
        return _node_table(found).add_column(0, "slot", pa.array([slot] * len(found), pa.int32()))

    dealt = table.mapInArrow(deal, DEALT)
    out: dict[int, list[tuple[int, int, Split]]] = {node: [] for node in nodes}
    for row in dealt.groupBy("slot").applyInArrow(grow, f"slot int, {NODE}").collect():
        out[slots[row.slot]].append((row.node, row.left, _split_of(row)))
    return {node: sorted(found, key=lambda x: x[1]) for node, found in out.items()}


def _grown(table: DataFrame, now: _Round, edges: list[list[float]], n_rows: int) -> Tree:
    """One tree: large nodes level by level over all tasks, small ones as whole subtrees."""
    s, tree = now.settings, Tree()

    def leaf(side: tuple[float, int]) -> tuple[float, int]:
        return -s.learning_rate * side[0] / (side[1] + s.reg_lambda), side[1]

    def apply(node: int, split: Split) -> int:
        feature = now.columns[split.feature]
        limit = edges[feature][split.bin - 1] if split.bin <= len(edges[feature]) else float("inf")
        return tree.split(node, feature, split.bin, limit, split.missing_left, split.gain, [leaf(split.left), leaf(split.right)])

    tree.add_leaf(0.0, n_rows)
    large, small, level = [0] if n_rows * s.subsample > s.local_rows else [], {}, 0
    if not large:
        small[0] = s.max_depth
    while large:
        tree.depth = level
        level += 1
        following = []
        for node, split in sorted(_searched(table, now, tree, large).items()):
            if split is None:
                continue
            left = apply(node, split)
            for child, (_, n) in ((left, split.left), (left + 1, split.right)):
                if level < s.max_depth and n > s.local_rows:
                    following.append(child)
                elif level < s.max_depth and n > 1:
                    small[child] = s.max_depth - level
        large = following
    tree.depth = level
    if small:
        for node, found in sorted(_finished(table, now, tree, small).items()):
            numbers = {0: node}
            for own, left, split in found:
                numbers[left] = apply(numbers[own], split)
                numbers[left + 1] = numbers[left] + 1
    tree.depth = s.max_depth
    return tree


def _errors(table: DataFrame, now: _Round) -> list[float]:
    """Root mean square error of the validation rows after each tree since the margins were written, in one pass."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in (block for batch in batches for block in _blocks(batch)):
            bins, rest = block.bins[:, block.held_out], (block.margin - block.y)[block.held_out]
            squares = []
            for tree, depth in now.since:
                rest = rest + tree["value"][trees.placed(tree, bins, depth, binned=True)]
                squares.append(float(rest @ rest))
            yield pa.record_batch([pa.array(range(len(squares)), pa.int32()), pa.array(squares), pa.array([len(rest)] * len(squares))], ["k", "e", "n"])

    totals = table.mapInArrow(add, "k int, e double, n long").groupBy("k").agg(F.sum("e").alias("e"), F.sum("n").alias("n")).collect()
    return [(r.e / r.n) ** 0.5 if r.n else float("nan") for r in sorted(totals, key=lambda r: r.k)]


def _refreshed(table: DataFrame, now: _Round) -> DataFrame:
    """``table`` with the trees since the last time added to the margins, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in (block for batch in batches for block in _blocks(batch)):
            margin = block.margin.copy()
            for tree, depth in now.since:
                margin += tree["value"][trees.placed(tree, block.bins, depth, binned=True)]
            yield _packed([tuple(x.tobytes() for x in block._replace(margin=margin))], BLOCK)

    return written(table.mapInArrow(run, BLOCK), "margins")


def fit(
    train: DataFrame,
    features: Sequence[str] | None = None,
    target: str = "sales",
    settings: BoostingSettings = BoostingSettings(),
    validation: DataFrame | None = None,
    stop: bool = True,
) -> BoostedTrees:
    """Fit on all rows with a target, whatever features they miss.

    With ``validation`` its error is kept after each tree, and training stops once it no longer improves (``stopped_early``);
    with ``stop=False`` it is only watched. Without any row with a target the model predicts 0.
    """
    features = list(features or numeric_features(train, target))
    every = train.withColumn("_held_out", F.lit(False))
    if validation is not None:
        every = every.unionByName(validation.withColumn("_held_out", F.lit(True)), allowMissingColumns=True)
    given = F.col(target).cast("double")
    told = train.agg(
        F.count("*").alias("all"), F.count(given).alias("n"), F.avg(given).alias("mean"), F.min(given).alias("low"), F.max(given).alias("high")
    ).first()
    lost = told.all - told.n
    if not told.n:
        return BoostedTrees(features, 0.0, [], 0, lost)
    edges = bin_edges(train.filter(F.col(target).isNotNull()), features)
    base = float(np.float32(told.mean))  # rounded, as the last bits of a mean depend on the order of the rows
    spread = 2 * max(told.high - told.low, 1e-9)
    table = written(_binned(every.filter(F.col(target).isNotNull()), features, target, edges, base), "binned")
    cuts = [edges[c] for c in features]
    usable = list(range(len(features)))
    now = _Round([], usable, 0, settings, min(UNITS, (1 << 62) // told.n) / spread)
    found: list[Tree] = []
    errors: list[float] = []
    for k in range(settings.n_estimators):
        chance = random.Random(settings.seed * 1_000_003 + k)
        some = sorted(chance.sample(usable, max(1, int(settings.colsample * len(usable)))))
        now = replace(now, columns=some, seed=chance.getrandbits(63))
        tree = _grown(table, now, cuts, told.n)
        found.append(tree)
        now = replace(now, since=[*now.since, (tree.arrays(), tree.depth)])
        last = k + 1 == settings.n_estimators
        if len(now.since) < REFRESH and not last:
            continue
        if validation is not None:
            errors += _errors(table, now)
            over = [n for n in range(1, len(errors) + 1) if n - best_count(errors[:n], settings) >= settings.patience]
            if stop and over:
                found, errors = found[: over[0]], errors[: over[0]]
                break
        if not last:
            before, table = table, _refreshed(table, now)
            discard(before)
            now = replace(now, since=[])
    discard(table)
    model = BoostedTrees(features, base, found, told.n, lost, tuple(errors))
    return stopped_early(model, settings) if stop and errors else model


def best_count(errors: Sequence[float], settings: BoostingSettings = BoostingSettings()) -> int:
    """How many trees to keep: up to the last one that lowered the validation error by the share ``validation_tol`` of the best
    one before, unless ``patience`` trees in a row did not."""
    kept, best = 0, float("inf")
    for k, error in enumerate(errors):
        if error < best * (1 - settings.validation_tol):
            kept, best = k + 1, error
        elif k + 1 - kept >= settings.patience:
            break
    return kept


def stopped_early(model: BoostedTrees, settings: BoostingSettings = BoostingSettings()) -> BoostedTrees:
    """The model as if training had stopped when its validation error no longer improved."""
    return replace(model, trees=model.trees[: best_count(model.errors, settings)])


def feature_names(model: BoostedTrees) -> list[str]:
    return model.features


def raw_prediction(model: BoostedTrees) -> Column:
    """The prediction for the feature columns of a row, in whole Arrow batches; missing features are followed like others."""

    base, held = model.base, model.held  # arrays: tasks read them much faster than the lists of the trees

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        return pd.Series(trees.scores(base, held, np.column_stack([c.to_numpy(np.float64) for c in columns])))

    return score(*[F.col(c).cast("double") for c in model.features])


def predict(model: BoostedTrees | None, df: DataFrame, output: str = "y_pred") -> DataFrame:
    """Add predictions, never below 0, for all rows, also those that miss features."""
    if model is None:
        raise NotFitted("fit a model first")
    return df.withColumn(output, F.greatest(raw_prediction(model), F.lit(0.0)))


def feature_importance(model: BoostedTrees | None, spark: SparkSession, top_n: int = 20) -> DataFrame:
    """``(feature, importance)``, most important first: mean gain of the splits on a feature, as a share of the sum of all."""
    if model is None:
        raise NotFitted("fit a model first")
    gains: dict[str, list[float]] = {c: [] for c in model.features}
    for tree in model.trees:
        for node, gain in enumerate(tree.gain):
            if not tree.is_leaf(node):
                gains[model.features[tree.feature[node]]].append(gain)
    means = {c: float(np.mean(g)) if g else 0.0 for c, g in gains.items()}
    total = sum(means.values()) or 1.0
    table = spark.createDataFrame([(c, m / total) for c, m in means.items()], "feature string, importance double")
    return table.orderBy(F.col("importance").desc(), "feature").limit(top_n)


def tree_count(model: BoostedTrees) -> int:
    """Trees in the model; fewer than asked for when training stopped early."""
    return len(model.trees)


def node_table(model: BoostedTrees, spark: SparkSession) -> DataFrame:
    """The model as rows, one per node: what a leaf adds, where an inner node splits."""
    columns = ("left", "feature", "threshold", "bin", "missing_left", "value", "gain", "cover")
    rows = [
        (t, node, *(getattr(tree, c)[node] for c in columns)) for t, tree in enumerate(model.trees) for node in range(len(tree.left))
    ]
    schema = "tree int, node int, left int, feature int, threshold double, bin int, missing_left boolean, value double, gain double, cover long"
    return spark.createDataFrame(rows, schema)


def described(model: BoostedTrees) -> str:
    """All of a model but its nodes, as JSON."""
    told = {k: v for k, v in asdict(replace(model, trees=[])).items() if k != "trees"}
    return json.dumps(told | {"depths": [t.depth for t in model.trees]})


def restored(told: str, nodes: DataFrame) -> BoostedTrees:
    """The model that ``described`` and ``node_table`` came from."""
    held = json.loads(told)
    depths = held.pop("depths")
    found = [Tree(depth=d) for d in depths]
    for row in nodes.orderBy("tree", "node").collect():
        tree = found[row.tree]
        for name in ("left", "feature", "threshold", "bin", "missing_left", "value", "gain", "cover"):
            getattr(tree, name).append(row[name])
    return BoostedTrees(**held | {"errors": tuple(held["errors"])}, trees=found)
