"""Approximate nearest neighbours by inner product: a hierarchical k-means tree searched best bin first.

Vectors are given one more component, sqrt(M^2 - |x|^2) with M the greatest norm of all; a query gets 0 there, and then
the nearest vector is the one of the largest inner product. The tree is fitted on a bounded sample, but every row is put
into a leaf. A query goes through the tree by a priority queue of nodes ordered by the distance of their centres. How
many leaves a query visits is calibrated: for some queries the true neighbours among all rows are found by brute force,
and visits are widened until the mean share of them that lies in visited leaves reaches the target. A query whose leaves
hold fewer rows than it has to find goes on to further leaves, so it gets all its neighbours wherever it lies.

A leaf is cut into tiles of bounded size and the queries that visit it come in blocks, one for each leaf and block, so a
leaf that holds a third of all rows, or that every query visits, is spread over many tasks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larderflow.llm.embedding_dedup import _blobs
from larderflow.llm.vectors import matrix
from larderflow.session import written

NEIGHBOURS = 20
# Rows the tree is fitted on, at most: those with the smallest hash of their id.
SAMPLE = 20_000
BRANCHES = 8
# Sampled rows in a leaf, about.
LEAF = 400
ITERATIONS = 8
# Queries compared with all rows to calibrate the visits.
PROBES = 128
RECALL = 0.95
TILE = 2048
BLOCK = 256


@dataclass
class Tree:
    """Centres, first child and number of children of each node (0 children: a leaf), for vectors with the extra component."""

    centres: np.ndarray
    first: np.ndarray
    children: np.ndarray
    norm: float

    def lifted(self, x: np.ndarray) -> np.ndarray:
        rest = np.maximum(self.norm**2 - np.einsum("ij,ij->i", x, x), 0)
        return np.c_[x, np.sqrt(rest)]

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf each vector is put into: always down to the nearest centre."""
        lifted, node = self.lifted(x), np.zeros(len(x), np.int64)
        while True:
            inner = np.unique(node[self.children[node] > 0])
            if not len(inner):
                return node
            for parent in inner.tolist():
                rows = np.flatnonzero(node == parent)
                a, n = self.first[parent], self.children[parent]
                node[rows] = a + _nearest(lifted[rows], self.centres[a : a + n])

    def visits(self, query: np.ndarray, n_leaves: int, rows: np.ndarray | None = None, least: int = 0) -> list[int]:
        """The first leaves that a query reaches, best bin first, and further ones until they hold ``least`` of ``rows``."""
        lifted = np.append(query, 0.0)
        queue, out, held = [(0.0, 0)], [], 0
        while queue and (len(out) < n_leaves or (rows is not None and held < least)):
            _, node = heapq.heappop(queue)
            if not self.children[node]:
                out.append(node)
                held += 0 if rows is None else int(rows[node])
                continue
            a, n = int(self.first[node]), int(self.children[node])
            apart = self.centres[a : a + n] - lifted
            for k, d in enumerate(np.einsum("ij,ij->i", apart, apart).tolist()):
                heapq.heappush(queue, (d, a + k))
        return out


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(1) - 2 * (x @ centres.T), axis=1)


def _split(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray] | None:
    """k-means with ``BRANCHES`` centres: centres in use and the part of each row; None if all rows are alike."""
    different = np.unique(x, axis=0)
    if len(different) < 2:
        return None
    centres = different[rng.choice(len(different), min(BRANCHES, len(different)), replace=False)]
    for _ in range(ITERATIONS):
        part = _nearest(x, centres)
        sums = np.stack([x[part == k].mean(0) if (part == k).any() else centres[k] for k in range(len(centres))])
        if np.allclose(sums, centres):
            break
        centres = sums
    part = _nearest(x, centres)
    used = np.unique(part)
    return (centres[used], np.searchsorted(used, part)) if len(used) > 1 else None


def fit(sample: np.ndarray, norm: float, seed: int = 7) -> Tree:
    """A tree over the sampled vectors."""
    rng = np.random.default_rng(seed)
    tree = Tree(np.zeros((1, sample.shape[1] + 1)), np.zeros(1, np.int64), np.zeros(1, np.int64), norm)
    lifted = tree.lifted(sample)
    centres, first, children = [lifted.mean(0) if len(lifted) else tree.centres[0]], [0], [0]
    todo = [(0, np.arange(len(lifted)))]
    while todo:
        node, rows = todo.pop()
        split = _split(lifted[rows], rng) if len(rows) > LEAF else None
        if split is None:
            continue
        first[node], children[node] = len(centres), len(split[0])
        for k, centre in enumerate(split[0]):
            centres.append(centre)
            first.append(0)
            children.append(0)
            todo.append((first[node] + k, rows[split[1] == k]))
    return Tree(np.stack(centres), np.array(first), np.array(children), norm)


def _best(ids: np.ndarray, x: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query its k best rows of a tile: (place of the query, place of the row, score), a query's own id left out.

    The products select; scores are then computed pair by pair, so equal vectors have equal scores wherever they stand.
    """
    rough = queries @ x.T
    rough[query_ids[:, None] == ids[None]] = -np.inf
    slack = 1e-9 * (1 + np.linalg.norm(queries, axis=1) * np.linalg.norm(x, axis=1).max(initial=0))
    if x.shape[0] > k:
        least = np.partition(rough, -k, axis=1)[:, -k]
        u, v = np.nonzero(rough >= np.where(np.isfinite(least), least - slack, np.finfo(float).min)[:, None])
    else:
        u, v = np.nonzero(rough != -np.inf)
    score = np.empty(len(u))
    for start in range(0, len(u), 20_000):  # ties may be many: bounded pieces
        piece = slice(start, start + 20_000)
        score[piece] = np.einsum("ij,ij->i", queries[u[piece]], x[v[piece]])
    order = np.lexsort((ids[v], -score, u))
    u, v, score = u[order], v[order], score[order]
    start = np.searchsorted(u, np.arange(len(queries)))
    kept = np.arange(len(u)) - start[u] < k
    return u[kept], v[kept], score[kept]


def _search(width: int, k: int):
    """The best rows of a tile for a block of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(len(batch)):
                ids, rows, query_ids, queries = (np.frombuffer(batch.column(c)[n].as_py(), t) for c, t in enumerate((np.int64, float) * 2))
                u, v, score = _best(ids, rows.reshape(-1, width), queries.reshape(-1, width), query_ids, k)
                yield pa.record_batch([pa.array(query_ids[u]), pa.array(ids[v]), pa.array(score)], ["query_id", "vec_id", "score"])

    return run


def _packed(table: pa.Table) -> pa.Table:
    return pa.table(
        {
            "leaf": table.column("leaf")[:1],
            "ids": [table.column("id").to_numpy().tobytes()],
            "vectors": [b"".join(table.column("vector").to_pylist())],
        }
    )


def _tiles(rows: DataFrame, size: int) -> DataFrame:
    """(leaf, ids, vectors): rows (leaf, id, vector) packed into tiles of about ``size``."""
    parts = rows.groupBy("leaf").agg(F.ceil(F.count("*") / size).alias("parts"))
    dealt = rows.join(parts, "leaf").withColumn("part", F.pmod(F.hash("id"), "parts"))
    return dealt.groupBy("leaf", "part").applyInArrow(_packed, "leaf long, ids binary, vectors binary")


def _top(found: DataFrame, k: int) -> DataFrame:
    window = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class Index:
    """All usable rows in the leaves of a tree, and the calibrated number of leaves to visit."""

    def __init__(self, vectors: DataFrame, queries: Column, id: str, vector: str, k: int, recall: float) -> None:
        told = vectors.select(F.col(id).cast("long").alias("id"), F.lit(0).alias("label"), vector)
        rows = told.mapInArrow(_blobs("id", "label"), "id long, label int, vector binary, width long")
        rows = written(rows.filter("id IS NOT NULL AND vector IS NOT NULL").drop("label"), "vectors")
        common = rows.groupBy("width").count().orderBy(F.desc("count"), "width").first()
        self.width = common.width if common else 1
        rows = rows.filter(F.col("width") == self.width).select("id", "vector")
        self.k, self.queries = k, rows.filter(queries)
        order = (F.xxhash64("id"), "id", "vector")
        sample = matrix([r.vector for r in rows.orderBy(*order).limit(SAMPLE).toLocalIterator()], self.width)
        self.tree = tree = fit(sample, self._greatest_norm(rows))

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                leaf = tree.leaf_of(matrix(batch.column(1).to_pylist(), len(tree.centres[0]) - 1))
                yield pa.record_batch([pa.array(leaf), *batch.columns], ["leaf", *batch.schema.names])

        self.rows = written(rows.mapInArrow(placed, "leaf long, id long, vector binary"), "leaves")
        # Rows that any query finds in a leaf, at least: rows that share an id may all be its own, here as in other leaves.
        self.held = np.zeros(len(tree.centres), np.int64)
        for r in self.rows.dropDuplicates(["leaf", "id"]).groupBy("leaf").count().collect():
            self.held[r.leaf] = r["count"] - 1
        probes = self.queries.orderBy(*order).limit(PROBES).collect()
        self.visits, self.measured = self._calibrated([(r.id, r.vector) for r in probes], recall)

    def _greatest_norm(self, rows: DataFrame) -> float:
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix(batch.column(0).to_pylist(), width)
                yield pa.record_batch([pa.array([np.linalg.norm(x, axis=1).max(initial=0)])], ["norm"])

        return rows.select("vector").mapInArrow(run, "norm double").agg(F.max("norm")).first()[0] or 0.0

    def _calibrated(self, probes: list[tuple[int, bytes]], recall: float) -> tuple[int, float]:
        """The number of leaves to visit, and the recall that the probes have then."""
        leaves = int((self.tree.children == 0).sum())
        if not probes:
            return leaves, 1.0
        ids, queries = np.array([p[0] for p in probes]), matrix([p[1] for p in probes], self.width)
        k, width = self.k, self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = batch.column(1).to_numpy()
                u, v, score = _best(own, matrix(batch.column(2).to_pylist(), width), queries, ids, k)
                yield pa.record_batch(
                    [pa.array(u), pa.array(own[v]), pa.array(score), pa.array(batch.column(0).to_numpy()[v])], ["query_id", "vec_id", "score", "leaf"]
                )

        found = self.rows.mapInArrow(run, "query_id long, vec_id long, score double, leaf long")
        window = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        truth = found.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k).select("query_id", "leaf").collect()
        needed = []
        order = [{leaf: at for at, leaf in enumerate(self.tree.visits(q, leaves))} for q in queries]
        for r in truth:
            needed.append(order[r.query_id][r.leaf] + 1)
        needed = np.sort(np.array(needed or [leaves]))
        visits = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])
        return visits, float((needed <= visits).mean())

    def search(self) -> DataFrame:
        """(query_id, rank, vec_id, score) of the best rows in the visited leaves, which hold k other rows if there are so many."""
        tree, visits, width, held, least = self.tree, self.visits, self.width, self.held, self.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, len(batch), BLOCK):
                    piece = batch.slice(start, BLOCK)
                    own, x = piece.column(0).to_numpy(), matrix(piece.column(1).to_pylist(), width)
                    leaves = [tree.visits(q, visits, held, least) for q in x]
                    row = np.repeat(np.arange(len(leaves)), [len(some) for some in leaves])
                    leaf = np.array([k for some in leaves for k in some], np.int64)
                    order = np.argsort(leaf, kind="stable")
                    kinds, at = np.unique(leaf[order], return_index=True)
                    parts = np.split(row[order], at[1:])
                    yield pa.record_batch(
                        [pa.array(kinds), pa.array([own[p].tobytes() for p in parts]), pa.array([x[p].tobytes() for p in parts])],
                        ["leaf", "query_ids", "queries"],
                    )

        blocks = self.queries.dropDuplicates(["id"]).mapInArrow(run, "leaf long, query_ids binary, queries binary")
        met = _tiles(self.rows, TILE).join(blocks, "leaf").select("ids", "vectors", "query_ids", "queries")
        return _top(met.mapInArrow(_search(width, self.k), "query_id long, vec_id long, score double"), self.k)


def search(
    vectors: DataFrame, queries: Column, id: str = "vec_id", vector: str = "embedding", k: int = NEIGHBOURS, recall: float = RECALL
) -> DataFrame:
    """The k nearest rows found for each query: ``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` (inner product).

    Queries are the rows of ``vectors`` for which ``queries``, a condition on the column ``id``, holds; candidates are all
    rows but those with the query's own id. Nearest first, ties to the smaller id; with fewer candidates all of them.
    Vectors that are null, empty, zero or hold a null or a non-finite component take no part, nor do rows with a null id
    or vectors of another length than the most common one. Of queries that share an id one is answered; as candidates
    repeated rows all count. Other columns are not read; an empty table gives no rows.
    """
    return Index(vectors, queries, id, vector, k, recall).search()
