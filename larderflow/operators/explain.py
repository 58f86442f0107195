"""Shapley attributions of predictions against a background sample, as one Spark job.

A game between an explained row and a background row: each feature has the value of either. The attribution of a feature is
its Shapley value in that game, averaged over the background rows; the sum is always prediction minus base value.

For boosted trees (``tree_attributions``) the values are exact: a leaf pays only if each feature on its path is followed
by one of the two rows, and its share for a feature depends only on how many features just the explained row follows, and how many
just the background row. For any other prediction (``attributions``) seeded feature orders are sampled: features switch one by one
from the background row's values to the explained row's, and each switch's change in prediction is credited to the feature.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator, Sequence
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from larderflow.operators import trees
from larderflow.operators.boosting import BoostedTrees, feature_names, raw_prediction

Predict = Callable[[DataFrame], DataFrame]


def background_sample(df: DataFrame, features: Sequence[str], n: int = 100, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, chosen by a seeded hash of the row, so a rerun gives the same sample."""
    order = F.xxhash64(F.lit(seed), *[F.col(c) for c in df.columns])
    return df.orderBy(order, *df.columns).limit(n).select(*features)


def feature_orders(n_features: int, n_orders: int, seed: int = 42) -> list[list[int]]:
    """Distinct seeded orders; all of them when there are no more than ``n_orders``."""
    if n_features <= 8 and factorial(n_features) <= n_orders:
        return [list(p) for p in permutations(range(n_features))]
    rng = random.Random(seed)
    orders: dict[tuple[int, ...], None] = {}
    while len(orders) < n_orders:
        order = list(range(n_features))
        rng.shuffle(order)
        orders[tuple(order)] = None
    return [list(o) for o in orders]


def attributions(
    model: BoostedTrees,
    rows: DataFrame,
    row_key: Sequence[str],
    background: DataFrame,
    n_orders: int = 8,
    seed: int = 42,
    predict: Predict | None = None,
) -> DataFrame:
    """Long ``(row_key, feature, feature_value, attribution, base_value, prediction)``.

    ``background`` must be a bounded sample: it travels as one array. Work is rows x orders x (features + 1) x
    background rows, spread over the tasks of ``rows``; all states of a row are made and averaged in its own task.
    """
    names = feature_names(model)
    predict = predict or (lambda df: df.withColumn("prediction", raw_prediction(model)))
    n_bg = background.select(*names).agg(
        F.collect_list(F.struct(*[F.col(c).cast("double").alias(c) for c in names])).alias("b")
    )
    orders = feature_orders(len(names), n_orders, seed)
    # positions[k] is where feature k stands in the order, order[j] the feature switched at step j + 1.
    choices = [
        F.struct(
            F.array(*[F.lit(o.index(k)) for k in range(len(names))]).alias("positions"),
            F.array(*[F.lit(k) for k in o]).alias("order"),
        )
        for o in orders
    ]
    key = list(row_key)
    states = (
        rows.select(*key, F.struct(*[F.col(c).cast("double").alias(c) for c in names]).alias("_row"))
        .withColumn("_background", n_bg.scalar())
        .withColumn("_choice", F.explode(F.array(*choices)))
        .withColumn("_step", F.explode(F.sequence(F.lit(0), F.lit(len(names)))))
        .withColumn("_bg", F.explode("_background"))
        .drop("_background")
    )
    mixed = states.withColumns(
        {
            c: F.when(F.col("_choice.positions")[k] < F.col("_step"), F.col(f"_row.{c}")).otherwise(F.col(f"_bg.{c}"))
            for k, c in enumerate(names)
        }
    )
    predicted = predict(mixed)
    just_on = F.try_element_at("_choice.order", F.col("_step"))
    next_on = F.try_element_at("_choice.order", F.col("_step") + 1)
    switched_on = F.when(F.col("_step") > 0, just_on)
    n_paths = F.count_if(F.col("_step") == 0)
    sums = []
    for k, c in enumerate(names):
        gain = F.sum(F.when(switched_on == k, F.col("prediction")))
        start = F.sum(F.when(next_on == k, F.col("prediction")))
        sums.append(((gain - start) / n_paths).alias(f"_a{k}"))
    totals = predicted.withColumn("_step", F.col("_step")).groupBy(*key).agg(
        F.first("_row").alias("_row"),
        F.avg(F.when(F.col("_step") == 0, F.col("prediction"))).alias("base_value"),
        F.avg(F.when(F.col("_step") == len(names), F.col("prediction"))).alias("prediction"),
        *sums,
    )
    cells = [
        F.struct(
            F.lit(c).alias("feature"), F.col(f"_row.{c}").alias("feature_value"), F.col(f"_a{k}").alias("attribution")
        )
        for k, c in enumerate(names)
    ]
    return totals.select(*key, "base_value", "prediction", F.inline(F.array(*cells)))


class _Paths:
    """All leaves of a model with the features on their paths: for every leaf up to ``width`` different ones."""

    def __init__(self, model: BoostedTrees) -> None:
        conditions: list[list[tuple[int, int, bool]]] = []  # of each leaf: (place of the inner node, slot, goes left)
        inner: list[tuple[int, float, bool]] = []  # feature, threshold, missing_left
        slots: list[list[int]] = []
        values: list[float] = []
        for tree in model.trees:
            waiting: list[tuple[int, list[tuple[int, bool]]]] = [(0, [])]
            while waiting:
                node, way = waiting.pop()
                if not tree.is_leaf(node):
                    inner.append((tree.feature[node], tree.threshold[node], tree.missing_left[node]))
                    step = len(inner) - 1
                    waiting += [(tree.left[node], [*way, (step, True)]), (tree.left[node] + 1, [*way, (step, False)])]
                    continue
                own = list(dict.fromkeys(inner[step][0] for step, _ in way))
                conditions.append([(step, own.index(inner[step][0]), left) for step, left in way])
                slots.append(own)
                values.append(tree.value[node])
        self.width = max(map(len, slots), default=0)
        self.values = np.array(values)
        self.inner = np.array(inner, float).reshape(-1, 3)
        self.features = np.array([own + [0] * (self.width - len(own)) for own in slots], np.int32).reshape(len(slots), self.width)
        self.whole = np.array([(1 << len(own)) - 1 for own in slots], np.uint32)
        longest = max(map(len, conditions), default=0)
        padded = [c + [(-1, 0, True)] * (longest - len(c)) for c in conditions]
        self.steps = np.array(padded, np.int32).reshape(len(padded), longest, 3)
        # Share of a leaf's value for one of a features that only the row follows, and of b that only the other one follows.
        n = self.width + 1
        self.gain, self.loss = np.zeros((n, n)), np.zeros((n, n))
        for a in range(n):
            for b in range(n - a):
                self.gain[a, b] = factorial(a - 1) * factorial(b) / factorial(a + b) if a else 0.0
                self.loss[a, b] = factorial(a) * factorial(b - 1) / factorial(a + b) if b else 0.0

    def followed(self, values: np.ndarray) -> np.ndarray:
        """By (row, leaf): the bits of the features whose conditions on the leaf's path the row meets."""
        x = values[:, self.inner[:, 0].astype(np.int64)]
        left = (x <= self.inner[:, 1]) | (np.isnan(x) & (self.inner[:, 2] > 0))
        bits = np.tile(self.whole, (len(values), 1))
        for k in range(self.steps.shape[1]):
            step, slot, goes_left = self.steps[:, k].T
            broken = (left[:, step] != (goes_left > 0)) & (step >= 0) if len(self.inner) else np.zeros(bits.shape, bool)
            bits &= ~(broken.astype(np.uint32) << slot.astype(np.uint32))
        return bits

    def patterns(self, others: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(leaf, bits not followed, background rows) of the background rows' bits (``others``): those that follow a leaf's path
        alike count once."""
        ordered = np.sort(others, 0)
        first = np.ones(ordered.shape, bool)
        first[1:] = ordered[1:] != ordered[:-1]
        leaf, at = np.nonzero(first.T)
        ends = np.append(np.where(leaf[1:] == leaf[:-1], at[1:], len(others)), len(others))[: len(at)]
        return leaf.astype(np.int32), self.whole[leaf] & ~ordered[at, leaf], (ends - at).astype(np.int32)

    def shares(self, row: np.ndarray, patterns: tuple[np.ndarray, np.ndarray, np.ndarray], n_features: int) -> np.ndarray:
        """Sums over the background rows (``patterns``) of all leaves' shares, by feature."""
        leaves, lacking, alike = patterns
        # what the background rows do not follow the row must
        at = np.flatnonzero((~row).take(leaves) & lacking == 0)
        leaf = leaves[at]
        mine, not_mine = lacking[at], self.whole[leaf] & ~row[leaf]
        a, b = np.bitwise_count(mine), np.bitwise_count(not_mine)
        paid = self.values[leaf] * alike[at]
        gain, loss = self.gain[a, b] * paid, self.loss[a, b] * paid
        total = np.zeros(n_features)
        for k in range(self.width):
            part = np.where(mine >> np.uint32(k) & 1, gain, 0.0) - np.where(not_mine >> np.uint32(k) & 1, loss, 0.0)
            total += np.bincount(self.features[leaf, k], part, n_features)
        return total


def tree_attributions(model: BoostedTrees, rows: DataFrame, row_key: Sequence[str], background: DataFrame) -> DataFrame:
    """Long ``(row_key, base_value, prediction, feature, feature_value, attribution)`` with the exact values for boosted trees.

    ``background`` must be a bounded sample: it goes to every task, whose work is its rows times background rows times
    leaves. Missing values follow the trees like others; predictions are those before the bound at 0.
    """
    names, key = feature_names(model), list(row_key)
    sample = np.array([[np.nan if x is None else x for x in r] for r in background.select(*[F.col(c).cast("double") for c in names]).collect()], float)
    sample = sample.reshape(-1, len(names))
    if not len(sample):
        raise ValueError("the background sample has no rows")
    paths = _Paths(model)
    if paths.width > 32:
        raise ValueError("paths of more than 32 different features are not supported")
    narrow = rows.select(*key, *[F.col(c).cast("double").alias(f"_x{k}") for k, c in enumerate(names)])
    fields = StructType.fromDDL("base_value double, prediction double, feature string, feature_value double, attribution double")

    # Leaves and patterns are made once and sent to each executor once; a task starts with its rows.
    sent = rows.sparkSession.sparkContext.broadcast((paths, paths.patterns(paths.followed(sample)), model.base, model.held))
    base = float(model.scores(sample).mean())
    n_sample = len(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, patterns, start_value, held = sent.value
        for whole in batches:
            for start in range(0, len(whole), 64):
                batch = whole.slice(start, 64)
                given = batch.columns[len(key) :]
                values = np.column_stack([pc.fill_null(c, float("nan")).to_numpy(zero_copy_only=False) for c in given])
                bits = paths.followed(values)
                found = np.array([paths.shares(row, patterns, len(names)) for row in bits]) / n_sample
                each = pa.array(np.repeat(np.arange(len(batch)), len(names)))
                columns = [c.take(each) for c in batch.columns[: len(key)]]
                columns += [pa.array(np.full(len(each), base)), pa.array(trees.scores(start_value, held, values)).take(each)]
                columns += [pa.array(names * len(batch)), pa.array(values.ravel(), from_pandas=True), pa.array(found.ravel())]
                yield pa.record_batch(columns, [*key, *fields.names])

    # A row costs far more than to send it, so rows are dealt over all tasks.
    dealt = narrow.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return dealt.mapInArrow(run, StructType([*narrow.schema.fields[: len(key)], *fields]))


def global_importance(attributed: DataFrame, top_n: int = 20) -> DataFrame:
    """Mean absolute attribution per feature, largest first."""
    return (
        attributed.groupBy("feature")
        .agg(F.avg(F.abs("attribution")).alias("importance"))
        .orderBy(F.col("importance").desc(), "feature")
        .limit(top_n)
    )


def explain_row(attributed: DataFrame, **key) -> DataFrame:
    """Attributions of one row, largest first, with base value and prediction."""
    for column, value in key.items():
        attributed = attributed.where(F.col(column) == F.lit(value))
    return attributed.orderBy(F.abs("attribution").desc(), "feature")
