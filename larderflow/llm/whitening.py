"""Whitening of embeddings: projections on the leading principal components, each divided by its standard deviation.

Entries are quantised to integers, so counts, sums and the products of centred vectors are exact however the rows are dealt
over tasks: each task sends one row per pair of dimensions, which is added up by a grouping. The covariance that comes out
has a fixed size (width squared) and is worked on by the driver.

Its leading eigenvalues are found by spectrum slicing. A factorisation P(V - sI)Pt = LDLt with diagonal blocks of one and two
(chosen by size, so no pivot is too small) has as many positive eigenvalues in D as V has eigenvalues above s. Halving an
interval by these counts isolates the k-th largest one; Rayleigh quotient iteration then converges cubically to an
eigenvector, and counts just below and above the quotient certify that it is number k. Equal eigenvalues cannot be told apart
by counts: the counts then certify how many there are, and further vectors of the same space are found orthogonal to those
before. A component without variance cannot be whitened and is left out, as are components beyond the width.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from larderflow.session import written

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
# Entries worked on at a time.
ENTRIES = 1 << 19
EXACT = "decimal(38,0)"
# Entries are held within these bounds, far from where a long or the exact products of doubles end.
LARGEST = 1 << 50
# An eigenvalue below this share of the trace, per dimension, is rounding.
NOISE = 2.0**-52


def inertia(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix are above ``shift``, by the signs of the blocks of an LDLt factorisation."""
    a = matrix - shift * np.eye(len(matrix))
    alpha = (1 + 17**0.5) / 8
    above = 0
    while len(a):
        diagonal = np.abs(np.diag(a))
        off = np.abs(a - np.diag(np.diag(a)))
        p = int(diagonal.argmax())
        if diagonal[p] >= alpha * off.max(initial=0.0):
            pivot = [p]
        else:
            pivot = list(np.unravel_index(off.argmax(), off.shape))
        block = a[np.ix_(pivot, pivot)]
        if len(pivot) == 1:
            above += int(block[0, 0] > 0)
            if block[0, 0] == 0:  # the rest is zero too
                break
        else:
            above += 1  # a block of two has a negative determinant by the choice of pivots
        rest = np.delete(np.arange(len(a)), pivot)
        side = a[np.ix_(rest, pivot)]
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(block, side.T)
        a = (a + a.T) / 2
    return above


def _against(vector: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for other in found:
            vector = vector - (other @ vector) * other
    return vector


def _rayleigh(matrix: np.ndarray, shift: float, found: list[np.ndarray], start: np.ndarray) -> tuple[float, np.ndarray]:
    """Rayleigh quotient iteration; two steps with a fixed shift first turn the start towards the wanted vector."""
    vector, value = _against(start, found), shift
    vector /= np.linalg.norm(vector)
    size = np.abs(matrix).max() or 1.0
    for step in range(40):
        moved = matrix - (shift if step < 2 else value) * np.eye(len(matrix))
        try:
            turned = np.linalg.solve(moved, vector)
        except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last bit
            turned = np.linalg.solve(moved + size * NOISE * np.eye(len(matrix)), vector)
        turned = _against(turned / np.abs(turned).max(), found)
        turned /= np.linalg.norm(turned)
        value = float(turned @ matrix @ turned)
        rest = np.linalg.norm(matrix @ turned - value * turned)
        vector = turned
        if step >= 2 and rest <= 4 * NOISE * size * len(matrix) ** 0.5:
            break
    return value, vector


def leading(matrix: np.ndarray, components: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a covariance, falling, and their unit eigenvectors as rows; none without variance.

    The interval of the k-th one is halved until counts say that it holds no other, or until its ends are as close as rounding
    allows (equal eigenvalues). If the iteration leaves the interval, it is halved further. Counts around the quotient then
    certify its number.
    """
    width = len(matrix)
    bound = float(np.abs(matrix).sum(1).max(initial=0.0)) * (1 + 2.0**-20)
    least = 8 * width * NOISE * bound
    start = np.cos(np.arange(width) + 1.0)
    values: list[float] = []
    found: list[np.ndarray] = []
    for k in range(1, min(components, inertia(matrix, 8 * width * NOISE * float(np.trace(matrix)))) + 1):
        low, high, above_low, above_high = -least, bound, width, 0
        while True:
            narrow = high - low <= least
            if narrow or (above_low == k and above_high == k - 1):
                value, vector = _rayleigh(matrix, (low + high) / 2, found, start)
                if low - least <= value <= high + least:
                    break
                if narrow:
                    raise ArithmeticError(f"no eigenvector found for eigenvalue {k} between {low} and {high}")
            middle = (low + high) / 2
            count = inertia(matrix, middle)
            low, above_low, high, above_high = (middle, count, high, above_high) if count >= k else (low, above_low, middle, count)
        if inertia(matrix, value - 4 * least) < k or inertia(matrix, value + 4 * least) > k - 1:
            raise ArithmeticError(f"the counts do not certify eigenvalue {k}: {value}")
        values.append(value)
        found.append(vector if vector[np.abs(vector).argmax()] > 0 else -vector)
    return np.array(values), np.array(found).reshape(len(values), width)


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: ``centre`` is the integer next to the mean, ``rest`` the sums of what is left (both exact)."""

    width: int
    n: int
    centre: list[int]
    rest: list[int]
    trace: float
    values: np.ndarray
    axes: np.ndarray

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace


def _usable(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and entries (as quantised) of the usable vectors of a batch, by width, some rows at a time."""
    lists = column.cast(pa.large_list(pa.float64()))
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.fill_null(lists.flatten(), float("nan")).to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for width in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == width)
        step = max(1, ENTRIES // width)
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            entries = values[starts[some][:, None] + np.arange(width)]
            good = np.isfinite(entries).all(1)
            with np.errstate(over="ignore"):
                scaled = np.clip(SCALE * entries[good], -LARGEST, LARGEST)
            yield some[good], np.floor(scaled).astype(np.int64) + SHIFT


def _products(y: np.ndarray) -> np.ndarray:
    """The exact sums of products of all pairs of columns, as Python integers if longs are too short."""
    most = int(np.abs(y).max(initial=0))
    if most * most * max(len(y), 1) < 1 << 53:  # exact in doubles
        held = y.astype(np.float64)
        return (held.T @ held).astype(np.int64).astype(object)
    held = y.astype(object)
    return held.T @ held


def _sums(vectors: DataFrame, vector: str) -> tuple[int, list[int]]:
    """How many usable vectors there are, and their sums by dimension; of several widths the most frequent counts."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _usable(batch.column(0)):
                width = x.shape[1]
                counts[width] = counts.get(width, 0) + len(x)
                totals[width] = totals.get(width, 0) + x.sum(0).astype(object)
        for width, total in totals.items():
            columns = [[width] * width, range(width), [counts[width]] * width, [str(v) for v in total]]
            yield pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.string()), strict=True)], ["width", "i", "n", "total"])

    parts = vectors.select(vector).mapInArrow(add, "width int, i int, n long, total string")
    sums = parts.groupBy("width", "i").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast(EXACT)).alias("total"))
    sums = written(sums, "sums")
    chosen = sums.filter("i = 0").orderBy(F.desc("n"), "width").first()
    if chosen is None:
        return 0, []
    rows = sums.filter(F.col("width") == chosen.width).orderBy("i").collect()
    return chosen.n, [int(r.total) for r in rows]


def fit(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all usable vectors (see ``whiten``); None if there are none."""
    n, sums = _sums(vectors, vector)
    if not n:
        return None
    width = len(sums)
    centre = [round(Fraction(s, n)) for s in sums]
    rest = [s - n * c for s, c in zip(sums, centre, strict=True)]
    upper = np.triu_indices(width)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width), object)
        for batch in batches:
            for _, x in _usable(batch.column(0)):
                if x.shape[1] == width:
                    total += _products(x - np.array(centre))
        yield pa.record_batch([*(pa.array(k.astype(np.int32)) for k in upper), pa.array([str(v) for v in total[upper]])], ["i", "j", "total"])

    parts = vectors.select(vector).mapInArrow(add, "i int, j int, total string")
    cells = parts.groupBy("i", "j").agg(F.sum(F.col("total").cast(EXACT)).alias("total")).collect()
    matrix = np.zeros((width, width))
    for r in cells:  # centred at the integers next to the means, then moved to the means themselves, without rounding
        matrix[r.i, r.j] = matrix[r.j, r.i] = float(Fraction(n * int(r.total) - rest[r.i] * rest[r.j], n * n))
    values, axes = leading(matrix, components)
    return Whitening(width, n, centre, rest, float(np.trace(matrix)), values, axes)


def _projected(model: Whitening, x: np.ndarray) -> np.ndarray:
    """Whitened components of quantised vectors."""
    centred = (x - np.array(model.centre)) - np.array([float(Fraction(r, model.n)) for r in model.rest])
    return centred @ model.axes.T / np.sqrt(model.values)


def _deviations(model: Whitening, x: np.ndarray) -> list[int | None]:
    """Sums over the dimensions of (n * x - S) squared; null where a long cannot hold it."""
    y, rest = x - np.array(model.centre), np.array(model.rest, dtype=object)
    most = model.n * int(np.abs(y).max(initial=0)) + int(max(map(abs, model.rest)))
    if most * most * model.width < 1 << 63:
        return ((model.n * y - rest.astype(np.int64)) ** 2).sum(1).tolist()
    return [v if v < 1 << 63 else None for v in ((model.n * y.astype(object) - rest) ** 2).sum(1).tolist()]


def identity_error(vectors: DataFrame, model: Whitening, vector: str = "embedding") -> float:
    """Largest absolute entry of the covariance of all whitened vectors minus the identity.

    Each task centres its own vectors before multiplying them; means and moments of the tasks are then merged.
    """
    count = len(model.values)
    if not count:
        return 0.0
    upper = np.triu_indices(count)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, moments = 0, np.zeros(count), np.zeros((count, count))
        for batch in batches:
            for _, x in _usable(batch.column(0)):
                if x.shape[1] == model.width and len(x):
                    w = _projected(model, x)
                    own = w.mean(0)
                    centred, apart = w - own, own - mean
                    moments += centred.T @ centred + np.outer(apart, apart) * (n * len(w) / (n + len(w)))
                    mean += apart * (len(w) / (n + len(w)))
                    n += len(w)
        columns = [*(k.astype(np.int32) for k in upper), np.full(len(upper[0]), n), mean[upper[0]], mean[upper[1]], moments[upper]]
        yield pa.record_batch([pa.array(c) for c in columns], ["i", "j", "n", "mean_i", "mean_j", "moment"])

    parts = vectors.select(vector).mapInArrow(add, "i int, j int, n long, mean_i double, mean_j double, moment double")
    n = F.sum("n")
    between = F.sum(F.col("n") * F.col("mean_i") * F.col("mean_j")) - F.sum(F.col("n") * F.col("mean_i")) * F.sum(F.col("n") * F.col("mean_j")) / n
    cell = (F.sum("moment") + between) / n
    cells = parts.groupBy("i", "j").agg(cell.alias("cell"))
    return cells.agg(F.max(F.abs(F.col("cell") - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0)))).first()[0]


def transform(vectors: DataFrame, model: Whitening | None, id: str = "vec_id", vector: str = "embedding", error: float | None = None) -> DataFrame:
    """Id, ``component``, ``n``, ``deviation``, ``whitened``, ``explained`` and ``identity_error`` of each usable vector and component."""
    kept = vectors.select(id, vector)
    names = [id, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    schema = StructType([kept.schema[0], *StructType.fromDDL("component int, n long, deviation long, whitened double, explained double, identity_error double")])
    if model is None:
        return kept.sparkSession.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = len(model.values)
        for batch in batches:
            for rows, x in _usable(batch.column(1)):
                if x.shape[1] != model.width or not len(x) or not count:
                    continue
                deviation = pa.array(_deviations(model, x), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), count)))
                columns = [
                    batch.column(0).take(pa.array(np.repeat(rows, count))), np.tile(np.arange(1, count + 1, dtype=np.int32), len(x)),
                    np.full(len(x) * count, model.n), deviation, _projected(model, x).ravel(), np.tile(model.explained, len(x)),
                    pa.array([error] * (len(x) * count), pa.float64()),
                ]
                yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)

    return kept.mapInArrow(run, schema)


def whiten(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Whitened leading components of all vectors, fitted on all of them.

    A vector that is null or empty or holds a null, infinite or undefined entry gives no rows, nor does one of another width
    than most (of equally frequent widths the smallest counts). Zero vectors, repeated rows and null ids are rows like any
    other; other columns are not looked at. Entries beyond 2^50 / 1024 are held at that bound. If all vectors are equal no
    component has variance, so there are no rows; an empty table gives none. A ``deviation`` that a long cannot hold is null.
    """
    model = fit(vectors, vector, components)
    error = identity_error(vectors, model, vector) if model is not None else None
    return transform(vectors, model, id, vector, error)
