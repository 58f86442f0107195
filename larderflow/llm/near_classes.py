"""Classes of near copies from sketches: one pass over the texts, everything after it on narrow rows.

The tokens of a text's set of word shingles are dealt by their upper bits to ``BINS`` bins, and the smallest of each bin is kept
(an empty bin takes that of the next one that has any). Two sets have the same value in a bin with a chance of their Jaccard
similarity, nearly. Equal sets are one from the start. Runs of ``ROWS`` bins are bands; sets that share a band are compared, by their
whole sketches, with the smallest id among them, and tied to it if they agree in ``AGREE`` of the bins. So a group of any
size costs one link a text and band.

This is an estimate, meant for uses where a missed or an extra pair does no harm: of two texts with a similarity of 0.75 the
chance to be tied in one step is over 0.98, with 0.5 it is about 0.04. ``ngram_join`` is the exact way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larderflow.llm import text as tx
from larderflow.llm.components import components
from larderflow.llm.ngram_join import SIZE, shingle_sets
from larderflow.session import written

BINS = 64
ROWS = 4
AGREE = 0.6
_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - 6)


def sketch(tokens: np.ndarray) -> np.ndarray:
    """The sketch of a sorted set of 64-bit tokens, not empty: ``BINS`` 32-bit values."""
    first = np.searchsorted(tokens, _EDGES)
    held = np.diff(np.r_[first, len(tokens)]) > 0
    following = np.flatnonzero(held)
    place = np.searchsorted(following, np.arange(BINS))
    source = following[place % len(following)]
    # How far the value was carried is part of it, so that carried values agree only if the same bins were empty.
    carried = (source - np.arange(BINS)) % BINS
    return tx.mix(tokens[first[source]] + carried.astype(np.uint64)).astype(np.uint32)


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        start = 0
        for sets, digests in shingle_sets(batch.column(1), SIZE):
            some = np.array([k for k, s in enumerate(sets) if len(s)], np.int64)
            rows = [sketch(sets[k]).tobytes() for k in some.tolist()]
            ids = batch.column(0).take(pa.array(some + start))
            yield pa.record_batch([ids, pa.array(digests[some].view(np.int64)), pa.array(rows, pa.binary())], ["id", "digest", "sketch"])
            start += len(sets)


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, band): the hash of each band of each sketch, with the number of the band in it."""
    n = BINS // ROWS
    for batch in batches:
        values = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(len(batch), n, ROWS).astype(np.uint64)
        total = np.zeros((len(batch), n), np.uint64)
        for k in range(ROWS):
            total = tx.mix(total + values[:, :, k] * np.uint64(0x9E3779B97F4A7C15))
        bands = tx.mix(total + np.arange(n, dtype=np.uint64))
        yield pa.record_batch([pa.array(np.repeat(batch.column(0).to_numpy(), n)), pa.array(bands.ravel().view(np.int64))], ["node", "band"])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        one, other = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint32).reshape(-1, BINS) for k in (2, 3))
        good = np.flatnonzero((one == other).mean(1) >= AGREE) if len(batch) else np.zeros(0, np.int64)
        yield pa.record_batch([batch.column(k).take(pa.array(good)) for k in (0, 1)], ["u", "v"])


def near_classes(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ``class``): rows of one class are copies or near copies of each other, as far as sketches tell.

    Ids are long. A null or empty text, or one without words, has no row; a null id has no class. Repeated rows come back as
    often. A text shorter than five words is compared as a whole. Other columns are not read; an empty table gives no rows.
    """
    sketched = written(docs.select(F.col(id).cast("long"), text).mapInArrow(_sketched, "id long, digest long, sketch binary"), "sketches")
    heads = sketched.groupBy("digest").agg(F.min("id").alias("node"), F.first("sketch").alias("sketch")).filter("node IS NOT NULL")
    heads = written(heads, "heads")
    bands = written(heads.select("node", "sketch").mapInArrow(_banded, "node long, band long"), "bands")
    least = bands.groupBy("band").agg(F.min("node").alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n")
    pairs = bands.join(least, "band").filter("node <> least").select("node", "least").distinct()
    sketches = heads.select("node", "sketch")
    both = pairs.join(sketches, "node").join(sketches.select(F.col("node").alias("least"), F.col("sketch").alias("other")), "least")
    links = both.select("node", "least", "sketch", "other").mapInArrow(_alike, "u long, v long")
    tied = heads.join(components(links), "node", "left").select("digest", F.coalesce("component", "node").alias("class"))
    return sketched.filter("id IS NOT NULL").join(tied, "digest").select(F.col("id").alias(id), "class")
