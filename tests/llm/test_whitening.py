from __future__ import annotations

import numpy as np
import pytest

from larderflow.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, component string"


def spread(rng, values):
    q, _ = np.linalg.qr(rng.normal(size=(len(values), len(values))))
    matrix = (q * values) @ q.T
    return (matrix + matrix.T) / 2


@pytest.mark.parametrize(
    "values",
    [
        np.arange(1.0, 41.0), np.r_[np.ones(10) * 3, np.zeros(6)], np.r_[5, 5, 5, 2, 2, 1e-3, np.zeros(4)], np.r_[1, 1 + 1e-14, 1 - 1e-9, 0.5, 0.1],
        np.logspace(0, -13, 20), np.array([7.0]), np.r_[1e12, 1e6, 1, 1e-6], np.linspace(1, 1.0001, 64),
    ],
)
def test_spectrum_slicing_equals_a_full_decomposition(values):
    matrix = spread(np.random.default_rng(len(values)), values)
    found, axes = whitening.leading(matrix)
    whole = np.sort(np.linalg.eigvalsh(matrix))[::-1]
    scale = np.abs(whole).max()
    assert len(found) == min(8, int((whole > 1e-13 * scale).sum()))
    assert np.abs(found - whole[: len(found)]).max() <= 1e-12 * scale
    assert np.abs(axes @ axes.T - np.eye(len(found))).max() < 1e-12
    assert np.abs(matrix @ axes.T - axes.T * found).max() <= 1e-11 * scale
    assert (np.diff(found) <= 1e-12 * scale).all()


def test_counts_of_eigenvalues():
    rng = np.random.default_rng(3)
    for _ in range(40):
        matrix = rng.normal(size=(9, 9))
        matrix = matrix + matrix.T
        matrix[np.abs(matrix) < 0.8] = 0
        np.fill_diagonal(matrix, 0)  # pivots of one alone would fail
        values = np.linalg.eigvalsh(matrix)
        for shift in [*((values[1:] + values[:-1]) / 2)[np.diff(values) > 1e-9], -50.0, 50.0]:
            assert whitening.inertia(matrix, shift) == (values > shift).sum()


def test_no_variance():
    assert whitening.leading(np.zeros((5, 5)))[0].size == 0
    assert len(whitening.leading(np.diag([0.0, 2.0, 0.0]))[0]) == 1


def rows_of_all_kinds(rng, width=10, n=400):
    base = rng.normal(size=(n, width)) @ rng.normal(size=(width, width)) / 10
    rows = [(k, [float(v) for v in x]) for k, x in enumerate(base.astype(np.float32))]
    rows += [(1000, None), (1001, []), (1002, [1.0] * 9 + [None]), (1003, [float("nan")] * width), (1004, [float("inf")] * width), (1005, [1.0, 2.0])]
    return rows + [(2000, [0.0] * width), (None, [0.5] * width)] + [(7, rows[7][1])] * 120


def brute(rows, width):
    good = [(i, v) for i, v in rows if v is not None and len(v) == width and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in v] for _, v in good], dtype=object)
    n, s = len(x), x.sum(0)
    deviations = ((n * x - s) ** 2).sum(1)
    centred = (x - np.array([float(v) / n for v in s])).astype(float)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return good, n, deviations, centred @ vectors[:, :8] / np.sqrt(values[:8]), values[:8] / values.sum()


def test_rows_of_all_kinds_equal_brute_force(spark):
    rows = rows_of_all_kinds(np.random.default_rng(1))
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(5)
    found = whitening.whiten(table)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    found = found.collect()
    good, n, deviations, whitened, explained = brute(rows, 10)
    assert len(found) == 8 * n and {r.n for r in found} == {n}
    assert len({r.identity_error for r in found}) == 1 and 0 < found[0].identity_error < 1e-10
    for c in range(1, 9):
        mine = sorted((str(r.vec_id), r.deviation, r.whitened) for r in found if r.component == c)
        want = [(str(i), int(d), w) for (i, _), d, w in zip(good, deviations, whitened[:, c - 1], strict=True)]
        same = max((abs(a[2] - b[2]) for a, b in zip(mine, sorted(want), strict=True)))
        flipped = max((abs(a[2] - b[2]) for a, b in zip(mine, sorted((i, d, -w) for i, d, w in want), strict=True)))
        assert min(same, flipped) < 1e-9
        assert [a[:2] for a in mine] == [a[:2] for a in sorted(want)]
        assert {r.explained for r in found if r.component == c}.pop() == pytest.approx(explained[c - 1], rel=1e-9)


def test_the_same_however_rows_are_dealt(spark):
    rows = [(*r, 1, "x") for r in rows_of_all_kinds(np.random.default_rng(2))]
    one, many = (whitening.fit(spark.createDataFrame(rows, SCHEMA).repartition(k)) for k in (1, 7))
    assert (one.values == many.values).all() and (one.axes == many.axes).all()


def test_few_equal_and_no_vectors(spark):
    table = spark.createDataFrame([(1, [1.0, 2.0], 1, "x"), (2, [1.0, 2.0], 1, "x")], SCHEMA)
    assert whitening.whiten(table).collect() == []
    assert whitening.whiten(table.limit(0)).collect() == []
    two = spark.createDataFrame([(1, [1.0, 2.0], 1, "x"), (2, [1.0, 3.0], 1, "x")], SCHEMA)
    assert sorted((r.vec_id, r.component, abs(r.whitened), r.explained) for r in whitening.whiten(two).collect()) == [(1, 1, 1.0, 1.0), (2, 1, 1.0, 1.0)]


def test_huge_entries(spark):
    rows = [(k, [v, float(k)], 1, "x") for k, v in enumerate([1e38, -1e38, 3.0, 4.0])]
    found = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.component for r in found} <= {1, 2} and all(np.isfinite(r.whitened) for r in found)
    assert any(r.deviation is None for r in found)
