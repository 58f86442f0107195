from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from larderflow.llm import ann, embedding_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, vector string, width int, node string"
BAD = [None, [], [0.0, 0.0, 0.0, 0.0], [1.0, None, 0.0, 0.0], [math.nan, 1.0, 0.0, 0.0], [math.inf, 1.0, 0.0, 0.0]]


def table(spark, rows):
    return spark.createDataFrame([(*r, "v", 1, "n") for r in rows], SCHEMA)


def brute_force(rows, threshold=0.98):
    def usable(x):
        return x is not None and len(x) > 0 and all(e is not None and math.isfinite(e) for e in x) and any(x)

    n = len(rows)
    unit = [np.float32(x).astype(float) / np.linalg.norm(np.float32(x).astype(float)) if usable(x) and c is not None else None for _, x, c in rows]
    linked = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2]
               and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in linked[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        least = min(ids) if ids else None
        out.append((rows[i][0], len(linked[i]), least, rows[i][0] is not None and rows[i][0] == least))
    return sorted(out, key=str)


@pytest.mark.parametrize("tile", [7, 1024])
def test_near_duplicates_equal_brute_force(spark, tile):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 12))
    rows = []
    for k in range(160):
        x = centres[k % 6] + rng.normal(size=12) * rng.choice([0.0, 0.05, 0.12, 0.6])
        rows.append((1000 - k, [float(v) for v in x * rng.choice([1.0, 3.0])], int(k % 6 < 4)))
    rows += [(2000 + k, x, 1) for k, x in enumerate(BAD)] + [(3000, rows[0][1], None), (3001, rows[0][1][:3], 1), (3002, rows[0][1][:3], 1)]
    rows += [rows[5], (None, rows[6][1], rows[6][2]), (None, [9.0, -9.0] * 6, 7)]
    result = embedding_dedup.near_duplicates(table(spark, rows), tile=tile)
    assert result.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, result.collect()), key=str) == brute_force(rows)


def test_near_duplicates_of_nothing(spark):
    assert embedding_dedup.near_duplicates(table(spark, [])).collect() == []
    only = embedding_dedup.near_duplicates(table(spark, [(1, None, 1)])).collect()
    assert [tuple(r) for r in only] == [(1, 0, 1, True)]


def test_tiles_find_the_same_links_as_all_dimensions():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 40)) * np.linspace(3, 0.1, 40)
    x[30:60] = x[:30] + rng.normal(size=(30, 40)) * 0.05
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    for threshold in (0.5, 0.9, 0.98):
        assert (embedding_dedup.linked(x[:50], x[40:], axes, threshold) == (x[:50] @ x[40:].T >= threshold)).all()


def nearest(rows, k):
    usable = [(i, np.float32(x).astype(float)) for i, x in rows if x is not None and len(x) == 4 and i is not None
              and all(e is not None and math.isfinite(e) for e in x) and any(x)]
    out = []
    for q, x in usable:
        if q % 20 == 0:
            ranked = sorted(((-(x @ y), i) for i, y in usable if i != q))[:k]
            out += [(q, r + 1, i) for r, (_, i) in enumerate(ranked)]
    return sorted(out)


def test_search_ties_and_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [float(v) for v in rng.integers(-2, 3, 4)]) for k in range(1, 90)]
    rows += [(100 + k, [2.0, 1.0, 0.0, 0.0]) for k in range(60)]  # many ties
    rows += [(400 + 20 * k, x) for k, x in enumerate(BAD)] + [(None, [1.0, 1.0, 1.0, 1.0]), (600, [1.0, 1.0])]
    data = table(spark, [(*r, 1) for r in rows])
    result = ann.search(data, F.col("id") % 20 == 0, recall=1.0)
    assert result.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted((r.query_id, r.rank, r.vec_id) for r in result.collect()) == nearest(rows, 20)
    assert ann.search(data.limit(0), F.col("id") % 20 == 0).collect() == []
    few = ann.search(data.filter("vec_id IN (40, 41, 43)"), F.col("id") % 20 == 0).collect()
    assert {(r.query_id, r.vec_id) for r in few} <= {(40, 41), (40, 43)}


def test_a_small_leaf_still_gives_all_neighbours(spark, monkeypatch):
    """A cluster of a few rows beside large ones, and an id that stands in its leaves very often."""
    monkeypatch.setattr(ann, "LEAF", 50)
    monkeypatch.setattr(ann, "PROBES", 10)
    rng = np.random.default_rng(6)
    rows = [(k, (np.eye(4)[k % 3] * 10 + rng.normal(size=4) * 0.1).tolist(), 1) for k in range(1, 1200)]
    rows += [(10_000 + 20 * k, [0.0, 0.0, 0.0, -10.0 - 0.01 * k], 1) for k in range(5)] + [(20_000, [0.0, 0.0, -10.0, 0.0], 1)] * 30
    found = ann.search(table(spark, rows), F.col("id") % 20 == 0, recall=0.5).groupBy("query_id").count().collect()
    assert {r.query_id for r in found} >= {10_000, 10_080, 20_000} and {r["count"] for r in found} == {20}


def test_search_reaches_recall(spark):
    data = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    found = ann.search(data, F.col("id") % 20 == 0).collect()
    rows = data.collect()
    x, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        score = x @ x[q]
        score[q] = -np.inf
        best = {int(i) for i in ids[np.lexsort((ids, -score))[:20]]}
        mine = {r.vec_id: r.score for r in found if r.query_id == ids[q]}
        assert len(mine) == 20 and all(abs(s - x[ids == i][0] @ x[q]) < 1e-12 for i, s in mine.items())
        hits, total = hits + len(best & set(mine)), total + 20
    assert hits / total >= 0.9
