"""Regression trees as flat arrays: placing rows, and the best split of histograms of gradients."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np

# Bin 0 holds missing values, present values lie in bins 1 to 255.
BINS = 256
# A split must gain more than rounding.
LEAST_GAIN = 1e-6
# Nodes whose histograms are searched at a time: bounds the temporary arrays.
NODES_AT_A_TIME = 64


@dataclass
class Tree:
    """Nodes by number, 0 is the root: ``left`` child (the right one follows it; a leaf points to itself), ``feature``,
    ``threshold`` and ``bin`` (rows up to them go left), ``missing_left``, ``value``, ``gain`` and ``cover`` (rows)."""

    left: list[int] = field(default_factory=list)
    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    missing_left: list[bool] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    cover: list[int] = field(default_factory=list)
    depth: int = 0

    def add_leaf(self, value: float, cover: int) -> int:
        node = len(self.left)
        for column, x in zip(
            (self.left, self.feature, self.threshold, self.bin, self.missing_left, self.value, self.gain, self.cover),
            (node, 0, float("inf"), BINS - 1, True, value, 0.0, cover),
            strict=True,
        ):
            column.append(x)
        return node

    def split(self, node: int, feature: int, bin: int, threshold: float, missing_left: bool, gain: float, leaves: Sequence[tuple[float, int]]) -> int:
        """Make a leaf an inner node with two leaves (value, rows); the number of the left one."""
        left, _ = (self.add_leaf(value, cover) for value, cover in leaves)
        self.left[node], self.feature[node], self.bin[node], self.threshold[node] = left, feature, bin, threshold
        self.missing_left[node], self.gain[node] = missing_left, gain
        return left

    def is_leaf(self, node: int) -> bool:
        return self.left[node] == node

    def arrays(self) -> dict[str, np.ndarray]:
        return {k: np.array(getattr(self, k)) for k in ("left", "feature", "threshold", "bin", "missing_left", "value")}


def placed(tree: dict[str, np.ndarray], rows: np.ndarray, depth: int, binned: bool) -> np.ndarray:
    """The leaf of each row: of bins by (feature, row) (0 for missing), or of values by (row, feature) (NaN for missing)."""
    flat, (n, width) = rows.reshape(-1), rows.shape[::-1] if binned else rows.shape
    base, step = (np.arange(n), n) if binned else (np.arange(n) * width, 1)
    node = np.zeros(n, np.int64)
    limit = tree["bin"] if binned else tree["threshold"]
    for _ in range(depth):
        x = flat[base + tree["feature"][node] * step]
        missing = x == 0 if binned else np.isnan(x)
        right = np.where(missing, ~tree["missing_left"][node], x > limit[node])
        node = tree["left"][node] + right
    return node


def scores(base: float, held: Sequence[tuple[dict[str, np.ndarray], int]], values: np.ndarray) -> np.ndarray:
    """``base`` plus the values of the leaves of trees (arrays and depths) that rows of feature values come to."""
    total = np.full(len(values), base)
    for tree, depth in held:
        total += tree["value"][placed(tree, values, depth, binned=False)]
    return total


def histogram(columns: Sequence[np.ndarray], slots: np.ndarray, gradients: np.ndarray, n_slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of gradients and numbers of rows by (slot, feature, bin), from the bins of each feature."""
    sums, counts = np.zeros((n_slots, len(columns), BINS)), np.zeros((n_slots, len(columns), BINS), np.int64)
    base = slots * BINS
    for k, column in enumerate(columns):
        cell = base + column
        sums[:, k] = np.bincount(cell, gradients, n_slots * BINS).reshape(n_slots, BINS)
        counts[:, k] = np.bincount(cell, minlength=n_slots * BINS).reshape(n_slots, BINS)
    return sums, counts


@dataclass(frozen=True)
class Split:
    """The best split of a node: sums of gradients and rows of both sides."""

    feature: int
    bin: int
    missing_left: bool
    gain: float
    left: tuple[float, int]
    right: tuple[float, int]


def best_splits(sums: np.ndarray, counts: np.ndarray, reg_lambda: float, min_child: float) -> list[Split | None]:
    """For each node the split of the largest gain, from ``sums`` and ``counts`` by (node, feature, bin).

    Rows without the feature go to the side where they gain more (to the left if they gain the same on both sides). Of equal
    gains the first feature, then the smallest bin counts. None if no split gains anything or leaves enough rows on both sides.
    """
    found: list[Split | None] = []
    for at in range(0, len(sums), NODES_AT_A_TIME):
        g, h = sums[at : at + NODES_AT_A_TIME], counts[at : at + NODES_AT_A_TIME].astype(np.float64)
        whole_g, whole_h = g.sum(2, keepdims=True), h.sum(2, keepdims=True)
        up_to_g, up_to_h = np.cumsum(g[:, :, 1:], 2), np.cumsum(h[:, :, 1:], 2)
        if h[:, :, 0].any():
            sides_g = np.stack([up_to_g + g[:, :, :1], up_to_g], 3)
            sides_h = np.stack([up_to_h + h[:, :, :1], up_to_h], 3)
        else:  # nothing is missing, so there is one way only
            sides_g, sides_h = up_to_g[..., None], up_to_h[..., None]
        rest_g, rest_h = whole_g[..., None] - sides_g, whole_h[..., None] - sides_h
        gain = sides_g**2 / (sides_h + reg_lambda) + rest_g**2 / (rest_h + reg_lambda)
        gain -= (whole_g**2 / (whole_h + reg_lambda))[..., None]
        gain[(sides_h < min_child) | (rest_h < min_child)] = -np.inf
        best = gain.reshape(len(g), -1).argmax(1)
        for k, place in enumerate(best.tolist()):
            f, b, side = np.unravel_index(place, gain.shape[1:])
            if not gain[k, f, b, side] > LEAST_GAIN:
                found.append(None)
                continue
            left, right = (sides_g[k, f, b, side], sides_h[k, f, b, side]), (rest_g[k, f, b, side], rest_h[k, f, b, side])
            found.append(Split(int(f), int(b) + 1, side == 0, float(gain[k, f, b, side]), *((float(x), int(n)) for x, n in (left, right))))
    return found


def grown(columns: np.ndarray, gradients: np.ndarray, depth: int, reg_lambda: float, min_child: float, scale: float) -> list[tuple]:
    """All splits below one node whose bins by (feature, row) are at hand, level by level: (node, left child, split); the node
    itself is 0.

    ``gradients`` are whole numbers, ``scale`` of them make one. Of two children only the smaller one is counted; the other
    has what is left of their parent.
    """
    place = np.zeros(len(gradients), np.int64)
    held = dict(zip("gn", histogram(columns, place, gradients, 1), strict=True))
    open_nodes, n_nodes, out = [0], 1, []
    for level in range(depth):
        splits = best_splits(held["g"] / scale, held["n"], reg_lambda, min_child)
        step = {k: np.zeros(n_nodes, np.int64) for k in ("left", "feature", "bin", "missing_left")}
        step["left"][:] = -1
        parents, smaller, following = [], [], []
        for slot, (node, split) in enumerate(zip(open_nodes, splits, strict=True)):
            if split is None:
                continue
            out.append((node, n_nodes, split))
            for k, v in (("left", n_nodes), ("feature", split.feature), ("bin", split.bin), ("missing_left", split.missing_left)):
                step[k][node] = v
            parents.append(slot)
            smaller.append(int(split.right[1] < split.left[1]))
            following += [n_nodes, n_nodes + 1]
            n_nodes += 2
        if not following or level + 1 == depth:
            break
        moving = np.flatnonzero(step["left"][place] >= 0)
        node = place[moving]
        x = columns[step["feature"][node], moving]
        place[moving] = step["left"][node] + np.where(x == 0, step["missing_left"][node] == 0, x > step["bin"][node])
        slot_of = np.full(n_nodes, -1)
        slot_of[[2 * k + following[0] + side for k, side in enumerate(smaller)]] = np.arange(len(smaller))
        slots = slot_of[place]
        inside = np.flatnonzero(slots >= 0)
        counted = histogram([c[inside] for c in columns], slots[inside], gradients[inside], len(smaller))
        for k, own in zip("gn", counted, strict=True):
            both = np.empty((len(following), *own.shape[1:]), own.dtype)
            both[2 * np.arange(len(smaller)) + smaller] = own
            both[2 * np.arange(len(smaller)) + 1 - np.array(smaller)] = held[k][parents] - own
            held[k] = both
        open_nodes = following
    return out
