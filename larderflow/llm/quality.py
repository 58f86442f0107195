"""Quality classifier: a generalised additive model with pairwise interactions, learnt by cyclic boosting.

Each text is described by a few numbers, each number falls into a bin, and a text's score is the logistic function of a
sum of table entries: one table per feature, and a two-way table for each chosen pair of features. The tables are the
sum of shallow trees, fitted to each feature in turn at a small rate, so no feature takes what another explains as well;
then the pairs that explain most of what is left are boosted the same way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larderflow.llm import text as tx
from larderflow.session import written

FEATURES = (
    "log_bytes", "log_words", "word_length", "upper", "digits", "stops", "marks", "symbols", "beyond_ascii", "newlines",
    "line_words", "distinct_words", "distinct_lines", "distinct_runs", "capitalised", "short_words", "ends_stop",
)
FOLDS = 5
HELD_OUT = 0
CUT = 0.3
# Labelled rows the model is fitted on at most: those with the smallest hash of their id.
SAMPLE = 20_000
BINS = 32
ROUNDS = 120
PAIRS = 6
PAIR_ROUNDS = 40
RATE = 0.15

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_CLASS = {
    "upper": range(65, 91),
    "digits": range(48, 58),
    "stops": b".!?",
    "marks": b",;:'\"()-",
    "symbols": b"#$%&*+/<=>@[\\]^_`{|}~",
    "beyond_ascii": range(192, 256),
    "newlines": b"\n",
}


def _flags(members) -> np.ndarray:
    table = np.zeros(256, np.int32)
    table[list(members)] = 1
    return table


_TABLES = {name: _flags(members) for name, members in _CLASS.items()}


def describe(column: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` per text; a null or empty text has zeros throughout."""
    data, offsets = tx.utf8(column)
    rows = []
    for i, j in tx.slices(offsets):
        rows.append(_described(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
    return np.concatenate(rows) if rows else np.zeros((0, len(FEATURES)))


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _distinct(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Different hashes in each text."""
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((hashes, owner))
    own, held = owner[order], hashes[order]
    fresh = np.r_[True, (held[1:] != held[:-1]) | (own[1:] != own[:-1])] if len(held) else np.zeros(0, bool)
    return np.bincount(own[fresh], minlength=len(at) - 1).astype(float)


def _described(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    size = np.diff(offsets).astype(float)
    starts, ends, at = tx.words(data, offsets)
    n = np.diff(at).astype(float)
    part = {name: _sums(table[data], offsets) / np.maximum(size, 1) for name, table in _TABLES.items()}
    hashes = tx.span_hashes(data, starts, ends)
    lengths = (ends - starts).astype(float)
    few = np.maximum(n, 1)
    runs = hashes.copy()
    runs[:-2] = tx.mix(hashes[:-2] + hashes[1:-1] * np.uint64(3) + hashes[2:] * np.uint64(7)) if len(hashes) > 2 else hashes[:-2]
    # Lines: the spans between line feeds, as starts of a text or behind a line feed.
    feeds = np.flatnonzero(data == 10)
    heads = np.union1d(feeds + 1, offsets[:-1])
    heads = heads[heads < len(data)]
    tails = np.r_[heads[1:], len(data)]
    line_at = np.searchsorted(heads, offsets)
    lines = np.diff(line_at).astype(float)
    end = np.maximum(tails - 1, heads)
    ends_line = np.where(data[end] == 10, end, tails) if len(heads) else tails
    line_hash = tx.span_hashes(data, heads, ends_line)
    last = data[ends - 1] if len(ends) else data[:0]
    first = data[starts] if len(starts) else data[:0]
    columns = [
        np.log1p(size), np.log1p(n), _sums(lengths, at) / few, part["upper"], part["digits"], part["stops"], part["marks"],
        part["symbols"], part["beyond_ascii"], part["newlines"], np.log1p(n / np.maximum(lines, 1)),
        _distinct(hashes, at) / few, _distinct(line_hash, line_at) / np.maximum(lines, 1), _distinct(runs, at) / few,
        _sums((first >= 65) & (first <= 90), at) / few, _sums(lengths <= 3, at) / few,
        _sums((last == 46) | (last == 33) | (last == 63), at) / few,
    ]
    return np.stack(columns, 1)


@dataclass
class Model:
    """Bin edges, one table per feature, and a table per pair of features, all in log odds."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return self._score_bins(self.bins(x)) if len(x) else np.zeros(0)

    def _score_bins(self, bins: np.ndarray) -> np.ndarray:
        total = np.full(len(bins), self.base)
        for f, table in enumerate(self.tables):
            total += table[bins[:, f]]
        for (f, g), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[bins[:, f], bins[:, g]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cut(gradient: np.ndarray, hessian: np.ndarray) -> tuple[float, int]:
    """The gain and place of the best cut of ordered bins in two."""
    g, h = np.cumsum(gradient), np.cumsum(hessian)
    left, right = g[:-1] ** 2 / (h[:-1] + 1), (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + 1)
    gain = left + right - g[-1] ** 2 / (h[-1] + 1)
    k = int(np.argmax(gain)) if len(gain) else -1
    return (float(gain[k]), k + 1) if k >= 0 else (0.0, 0)


def _tree(gradient: np.ndarray, hessian: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf values over ordered bins of a tree of ``depth`` cuts."""
    gain, k = _cut(gradient, hessian) if depth else (0.0, 0)
    if gain <= 1e-6:
        return np.full(len(gradient), gradient.sum() / (hessian.sum() + 1))
    return np.r_[_tree(gradient[:k], hessian[:k], depth - 1), _tree(gradient[k:], hessian[k:], depth - 1)]


def _pair_tree(gradient: np.ndarray, hessian: np.ndarray) -> tuple[float, np.ndarray]:
    """The gain and leaf values of the best pair of cuts, first along one side and then each part along the other."""
    best, values = 0.0, np.zeros_like(gradient)
    for flip in (False, True):
        g, h = (gradient.T, hessian.T) if flip else (gradient, hessian)
        _, k = _cut(g.sum(1), h.sum(1))
        out, gain = np.zeros_like(g), 0.0
        for rows in (slice(0, k), slice(k, None)):
            a, b = g[rows].sum(0), h[rows].sum(0)
            leaf = _tree(a, b, 1)
            gain += float((a * leaf).sum())
            out[rows] = leaf
        if gain > best:
            best, values = gain, out.T if flip else out
    return best, values


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Fit on feature rows and 0/1 labels. Without rows, or with one label only, every text gets the smoothed rate."""
    rate = (y.sum() + 1) / (len(y) + 2)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(len(FEATURES))]
    model = Model(float(np.log(rate / (1 - rate))), edges, [np.zeros(len(e) + 1) for e in edges], [], [])
    if len(np.unique(y)) < 2:
        return model
    bins = model.bins(x)
    total = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for f, table in enumerate(model.tables):
            g, h = slopes()
            own = bins[:, f]
            step = RATE * _tree(np.bincount(own, g, len(table)), np.bincount(own, h, len(table)))
            table += step
            total += step[own]

    def crossed(f: int, g: int, values: np.ndarray) -> np.ndarray:
        a, b = len(model.tables[f]), len(model.tables[g])
        return np.bincount(bins[:, f] * b + bins[:, g], values, a * b).reshape(a, b)

    g, h = slopes()
    n = len(FEATURES)
    gains = sorted(((_pair_tree(crossed(a, b, g), crossed(a, b, h))[0], a, b) for a in range(n) for b in range(a)), reverse=True)
    model.pairs = [(a, b) for gain, a, b in gains[:PAIRS] if gain > 1]
    model.pair_tables = [np.zeros((len(model.tables[a]), len(model.tables[b]))) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (a, b), table in zip(model.pairs, model.pair_tables, strict=True):
            g, h = slopes()
            step = RATE * _pair_tree(crossed(a, b, g), crossed(a, b, h))[1]
            table += step
            total += step[bins[:, a], bins[:, b]]
    return model


def described(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, features) of each row of ``docs``, features an array in the order of ``FEATURES``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = describe(batch.column(1))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.record_batch([batch.column(0), lists], [id, "features"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(id, text).mapInArrow(run, f"{id} {kind}, features array<double>")


def fold(id: str, folds: int):
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(id).cast("string")) % folds


def trained(table: DataFrame, labels: DataFrame, id: str = "doc_id", label: str = "quality") -> Model:
    """The model learnt from the described texts that have a label and lie outside the held-out fold."""
    known = labels.select(F.col(id).alias("_id"), F.col(label).cast("double").alias("_label")).filter("_label IS NOT NULL")
    rows = (
        table.filter(fold(id, FOLDS) != HELD_OUT).join(known, F.col(id) == F.col("_id"))
        .select("features", "_label", F.xxhash64(id).alias("_order"), id)
        .orderBy("_order", id, "_label").limit(SAMPLE).toArrow()
    )
    x = np.array(rows.column("features").to_pylist(), float).reshape(-1, len(FEATURES))
    return fit(x, rows.column("_label").to_numpy())


def score(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """One row per row of ``docs``: id, ``held_out``, ``score`` (0 to 1, higher: better) and ``predicted`` (0 or 1).

    Labels are learnt from rows outside the held-out fold, from at most ``SAMPLE`` of them. Scores depend on the text
    alone. Null and empty texts are scored by their (zero) features. Rows with a null id are scored, count as not held
    out and are never learnt from; null labels are not learnt from either. Repeated rows all come back. Without any
    label every score is 0.5. Very long texts are read whole, and equal texts have equal scores. Other columns are not
    read, and an empty table gives no rows.
    """
    table = written(described(docs, id, text), "features")
    model = trained(table, labels, id, label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.record_batch([batch.column(0), pa.array(model.score(flat))], [id, "score"])

    kind = docs.schema[id].dataType.simpleString()
    scored = table.mapInArrow(run, f"{id} {kind}, score double")
    held = F.coalesce(fold(id, FOLDS) == HELD_OUT, F.lit(False))
    return scored.select(id, held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores ``CUT`` or more; see ``score`` for odd rows."""
    model = trained(written(described(docs, id, text), "features"), labels, id, label)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(describe(batch.column(place))) >= CUT))

    return docs.mapInArrow(run, docs.schema)
