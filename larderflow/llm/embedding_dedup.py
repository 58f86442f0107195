"""Near-duplicate vectors by PCA-ordered tiles: every pair of one label whose cosine reaches a threshold.

Unit vectors are turned so that their leading components carry most of their length (the eigenvectors of the second
moments of all of them). Two vectors of cosine t or more are at most sqrt(2 - 2 t) apart, in every component too, so
cells of that width along the first component only meet their neighbours. Cells are cut into tiles; for two tiles the
products are summed over the leading components first, what the rest can add is bounded by the product of the norms of
the rests, and the work stops when no pair can reach the threshold any more.

Vectors of equal label and components are one vector with a weight from the start, so copies are never paired.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larderflow.llm.components import components
from larderflow.llm.vectors import unpacked
from larderflow.session import written

THRESHOLD = 0.98
TILE = 1024
STEPS = (4, 8, 16, 32)
# Cosines so close to the threshold are computed again from the vectors as given.
DOUBT = 1e-9


def _blobs(id: str, label: str):
    """Usable vectors as bytes of doubles (null for others), with their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, offsets, usable = unpacked(batch.column(2))
            values = values + 0.0  # one zero only
            blobs = [values[a:b].tobytes() if ok else None for a, b, ok in zip(offsets[:-1], offsets[1:], usable, strict=True)]
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(blobs, pa.binary()), pa.array(np.diff(offsets))], [id, label, "vector", "width"]
            )

    return run


def principal_axes(vectors: DataFrame, width: int) -> np.ndarray:
    """Columns: eigenvectors of the second moments of all unit vectors, by falling eigenvalue."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = _unit(b"".join(batch.column(0).to_pylist()), width)
            total += x.T @ x
        i, j = np.triu_indices(width)
        yield pa.record_batch([pa.array(i), pa.array(j), pa.array(total[i, j])], ["i", "j", "value"])

    moments = vectors.select("vector").mapInArrow(run, "i long, j long, value double")
    rows = moments.groupBy("i", "j").agg(F.sum("value").alias("value")).toArrow()  # width * (width + 1) / 2 rows
    total = np.zeros((width, width))
    total[rows.column("i").to_numpy(), rows.column("j").to_numpy()] = rows.column("value").to_numpy()
    total += np.triu(total, 1).T
    return np.linalg.eigh(total)[1][:, ::-1]


def _unit(blobs: bytes, width: int) -> np.ndarray:
    x = np.frombuffer(blobs, np.float64).reshape(-1, width)
    scale = np.abs(x).max(1, keepdims=True)  # very long and very short vectors neither overflow nor vanish
    x = x / scale
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def linked(left: np.ndarray, right: np.ndarray, axes: np.ndarray, threshold: float) -> np.ndarray:
    """Which unit vectors of the two tiles have a cosine of ``threshold`` or more."""
    a, b = left @ axes, right @ axes
    width = a.shape[1]
    rests = [np.sqrt(np.maximum(np.cumsum((x * x)[:, ::-1], 1)[:, ::-1], 0)) for x in (a, b)]
    total = np.zeros((len(a), len(b)))
    done = 0
    for step in [*[s for s in STEPS if s < width], width]:
        total += a[:, done:step] @ b[:, done:step].T
        done = step
        if done == width:
            break
        alive = total + np.outer(rests[0][:, done], rests[1][:, done]) >= threshold - DOUBT
        if not alive.any():
            return alive
        if alive.mean() < 0.02:  # few pairs are left: go on with them alone
            u, v = np.nonzero(alive)
            total[:] = -1
            total[u, v] = np.einsum("ij,ij->i", a[u], b[v])
            break
    found = total >= threshold
    u, v = np.nonzero(np.abs(total - threshold) < DOUBT)
    if len(u):
        found[u, v] = np.einsum("ij,ij->i", left[u], right[v]) >= threshold
    return found


def _roots(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least row that each row and each column reaches through links; the number of rows where a column has none."""
    far = len(found)
    rows, columns = np.arange(far), np.full(found.shape[1], far)
    while True:
        columns_now = np.minimum(columns, np.where(found, rows[:, None], far).min(0, initial=far))
        rows_now = np.minimum(rows, np.where(found, columns_now[None], far).min(1, initial=far))
        if (rows_now == rows).all() and (columns_now == columns).all():
            return rows, columns
        rows, columns = rows_now, columns_now


def _pairs(axes: np.ndarray, main_width: int, threshold: float):
    """Per pair of tiles: (node, links, null) for the weight each vector links to, (node, null, other) for a spanning forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                width, same = row["width"], row["home"] == row["other"]
                nodes = [np.frombuffer(row[k]["nodes"], np.int64) for k in ("left", "right")]
                weights = [np.frombuffer(row[k]["weights"], np.int64) for k in ("left", "right")]
                left, right = (_unit(row[k]["vectors"], width) for k in ("left", "right"))
                found = linked(left, right, axes if width == main_width else np.eye(width), threshold)
                if same:
                    np.fill_diagonal(found, False)
                out = [(nodes[0], found @ weights[1])]
                if not same:
                    out.append((nodes[1], weights[0] @ found))
                near, far = _roots(found)
                ties = [(nodes[0], near), (nodes[1], far)]
                node = np.concatenate([n[w > 0] for n, w in out])
                links = np.concatenate([w[w > 0] for _, w in out])
                u = np.concatenate([n[r < len(found)] for n, r in ties])
                v = np.concatenate([nodes[0][r[r < len(found)]] for _, r in ties])
                u, v = u[u != v], v[u != v]
                yield pa.record_batch(
                    [
                        pa.array(np.r_[node, u], pa.int64()),
                        pa.concat_arrays([pa.array(links, pa.int64()), pa.nulls(len(u), pa.int64())]),
                        pa.concat_arrays([pa.nulls(len(node), pa.int64()), pa.array(v, pa.int64())]),
                    ],
                    ["node", "links", "other"],
                )

    return run


def _tile(table: pa.Table) -> pa.Table:
    packed = {
        "nodes": [table.column("node").to_numpy().tobytes()],
        "weights": [table.column("weight").to_numpy().tobytes()],
        "vectors": [b"".join(table.column("vector").to_pylist())],
    }
    return pa.table({**{k: table.column(k)[:1] for k in ("_label", "width", "cell", "home")}, **packed})


def near_duplicates(
    vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, tile: int = TILE
) -> DataFrame:
    """One row per row of ``vectors``: id, ``n_links`` (other vectors linked directly), ``component_id`` (smallest id
    reachable by links, its own included) and ``kept`` (whether that is its own id).

    Two vectors link if their labels are equal and not null, their lengths are equal and their cosine, in double
    precision, is at least ``threshold``. Vectors that are null, empty, zero or hold a null or a non-finite component
    link with nothing. Repeated rows are vectors of their own. A row with a null id takes part but never names a
    component; its ``kept`` is false, and a component of such rows only has a null ``component_id``. Other columns are not read; an
    empty table gives no rows.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie in (0, 1]")
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    blobs = vectors.select(id, label, vector).mapInArrow(_blobs(id, label), f"{id} {kinds[id]}, {label} {kinds[label]}, vector binary, width long")
    node = F.when(F.col("vector").isNotNull() & F.col(label).isNotNull(), F.xxhash64(label, "vector"))
    rows = written(blobs.select(F.col(id), F.col(label).alias("_label"), "vector", "width", node.alias("node")), "vectors")
    one = rows.filter("node IS NOT NULL").groupBy("_label", "width", "node").agg(F.first("vector").alias("vector"), F.count("*").alias("weight"))
    widths = one.groupBy("width").count().orderBy(F.desc("count"), "width").first()
    width = widths.width if widths else 1
    axes = principal_axes(one.filter(F.col("width") == width), width)
    step = float(np.sqrt(2 - 2 * threshold)) + 1e-9

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [
                int(np.floor((_unit(blob, n) @ axes[:, 0])[0] / step)) if n == width else 0
                for blob, n in zip(batch.column(3).to_pylist(), batch.column(1).to_pylist(), strict=True)
            ]
            yield pa.record_batch([*batch.columns, pa.array(cells, pa.int64())], [*batch.schema.names, "cell"])

    placed = one.select("_label", "width", "node", "vector", "weight").mapInArrow(
        celled, f"_label {kinds[label]}, width long, node long, vector binary, weight long, cell long"
    )
    placed = written(placed, "cells")
    parts = placed.groupBy("_label", "width", "cell").agg(F.ceil(F.count("*") / tile).alias("parts"))
    home = F.pmod(F.hash("node"), "parts").cast("long").alias("home")
    tiles = written(
        placed.join(parts, ["_label", "width", "cell"]).select("_label", "width", "cell", home, "node", "weight", "vector")
        .groupBy("_label", "width", "cell", "home")
        .applyInArrow(_tile, f"_label {kinds[label]}, width long, cell long, home long, nodes binary, weights binary, vectors binary"),
        "tiles",
    )
    keys = tiles.select("_label", "width", "cell", "home")
    own = keys.join(keys.withColumnRenamed("home", "other"), ["_label", "width", "cell"]).filter("home <= other")
    own = own.select("_label", "width", "cell", "home", F.col("cell").alias("next"), "other")
    near = keys.withColumn("next", F.col("cell") + 1).join(
        keys.select("_label", "width", F.col("cell").alias("next"), F.col("home").alias("other")), ["_label", "width", "next"]
    )
    pairs = own.unionByName(near.select("_label", "width", "cell", "home", "next", "other"))
    packed = F.struct("nodes", "weights", "vectors")
    left = tiles.select("_label", "width", "cell", "home", packed.alias("left"))
    right = tiles.select("_label", "width", F.col("cell").alias("next"), F.col("home").alias("other"), packed.alias("right"))
    met = pairs.join(left, ["_label", "width", "cell", "home"]).join(right, ["_label", "width", "next", "other"])
    # A tile of one cell and one of the next may have the same number: only tiles of one cell are "the same".
    met = met.select("width", F.concat_ws("/", "cell", "home").alias("home"), F.concat_ws("/", "next", "other").alias("other"), "left", "right")
    found = written(met.mapInArrow(_pairs(axes, width, threshold), "node long, links long, other long"), "found")
    joined = components(found.filter("other IS NOT NULL").select(F.col("node").alias("u"), F.col("other").alias("v")))
    counts = found.filter("links IS NOT NULL").groupBy("node").agg(F.sum("links").alias("links"))
    weights = placed.select("node", "weight")
    about = weights.join(counts, "node", "left").join(joined, "node", "left").select(
        "node", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")
    )
    told = written(rows.select(id, "node").join(about, "node", "left"), "members")
    linked_rows = told.filter("component IS NOT NULL")
    least = linked_rows.groupBy("component").agg(F.min(id).alias("component_id"))
    named = linked_rows.join(least, "component").select(id, "n_links", "component_id")
    alone = told.filter("component IS NULL").select(id, F.lit(0).cast("long").alias("n_links"), F.col(id).alias("component_id"))
    return named.unionAll(alone).withColumn("kept", F.coalesce(F.col(id) == F.col("component_id"), F.lit(False)))
