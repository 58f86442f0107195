"""Best-fit packing under conflicts: texts are put into bins of a fixed number of tokens, largest first.

A bin takes at most one text of a source and at most one of a group of copies, near copies included if they are asked for.
A bin carries these sets as bitmaps, bins
are ordered by what is left in them, and the search starts at the first bin that is large enough and moves on to its
successors until one has no bit in common with the text: that is the tightest compatible bin. With none, a new bin is
opened. Texts longer than a bin are cut; their full pieces fill bins of their own and the rest is packed as a text.

Packing is sequential, so the texts are dealt out at random to shards of a bounded size, each packed by one task. Shards
share no bins. A large share of one source, or of copies, spreads evenly over them.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larderflow.llm.near_classes import near_classes
from larderflow.session import written

CAPACITY = 2048
# Pieces packed together by one task. More pieces make more shards.
SHARD = 10_000
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: str) -> Column:
    """Words of a text, runs of other than white space; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def copy_key(text: str) -> Column:
    """Equal for texts that differ only in letter case and white space."""
    return F.md5(F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[\x20\x09-\x0D]+", " ")))


class _Blocks:
    """Bins ordered by (left, number), in blocks of bounded length; each block knows the bits that all its bins have.

    A block of which every bin has a bit of the text cannot hold it, so the search passes over it in one step.
    """

    LENGTH = 128

    def __init__(self) -> None:
        self.keys: list[list[tuple[int, int]]] = [[]]
        self.bits: list[list[int]] = [[]]
        self.all: list[int] = [-1]

    def _first(self, key: tuple[int, int]) -> int:
        low, high = 0, len(self.keys) - 1
        while low < high:
            middle = (low + high) // 2
            if self.keys[middle] and self.keys[middle][-1] >= key:
                high = middle
            else:
                low = middle + 1
        return low

    def add(self, left: int, number: int, bits: int) -> None:
        block = self._first((left, number))
        keys, held = self.keys[block], self.bits[block]
        at = bisect_left(keys, (left, number))
        keys.insert(at, (left, number))
        held.insert(at, bits)
        self.all[block] &= bits
        if len(keys) > self.LENGTH:
            half = len(keys) // 2
            self.keys[block : block + 1] = [keys[:half], keys[half:]]
            self.bits[block : block + 1] = [held[:half], held[half:]]
            self.all[block : block + 1] = [self._common(held[:half]), self._common(held[half:])]

    @staticmethod
    def _common(held: list[int]) -> int:
        common = -1
        for bits in held:
            common &= bits
        return common

    def take(self, size: int, bits: int) -> tuple[int, int, int] | None:
        """Remove and return (left, number, bits) of the tightest bin with room for ``size`` and none of ``bits``."""
        key = (size, -1)
        block = self._first(key)
        at = bisect_left(self.keys[block], key)
        while block < len(self.keys):
            if not self.all[block] & bits:
                held = self.bits[block]
                for k in range(at, len(held)):
                    if not held[k] & bits:
                        left, number = self.keys[block].pop(k)
                        found = held.pop(k)
                        if held:
                            self.all[block] = self._common(held)
                        elif len(self.keys) > 1:
                            del self.keys[block], self.bits[block], self.all[block]
                        else:
                            self.all[block] = -1
                        return left, number, found
            block, at = block + 1, 0
        return None


def pack(sizes: list[int], sources: list, copies: list, capacity: int, classes: list | None = None) -> list[int]:
    """The bin number of each piece, numbered as they are opened. Pieces are taken by falling size, ties as they come.

    ``classes`` are groups of near copies. A null source or group of either kind conflicts with nothing. Pieces of size 0 are put into bins like others.
    """
    known: dict = {}

    def bit(kind: str, value) -> int:
        return 0 if value is None else 1 << known.setdefault((kind, value), len(known))

    classes = classes or [None] * len(sizes)
    counted, alike = Counter(copies), Counter(classes)
    bins, where, opened = _Blocks(), [0] * len(sizes), 0
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        bits = bit("source", sources[k]) | (bit("copy", copies[k]) if counted[copies[k]] > 1 else 0)
        bits |= bit("class", classes[k]) if alike[classes[k]] > 1 else 0
        found = bins.take(sizes[k], bits)
        left, number, held = found or (capacity, opened, 0)
        opened += found is None
        where[k] = number
        bins.add(left - sizes[k], number, held | bits)
    return where


def pieces(docs: DataFrame, id: str, text: str, source: str) -> DataFrame:
    """(id, n_tokens, source, copies, order): one row per row of ``docs``."""
    return docs.select(
        F.col(id), n_words(text).alias("n_tokens"), F.col(source).alias("source"), copy_key(text).alias("copies"),
        F.xxhash64(id, text).alias("order"),
    )


def best_fit(
    docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", capacity: int = CAPACITY, shard: int = SHARD,
    near_copies: bool = False,
) -> DataFrame:
    """One row per piece: id, ``piece`` (from 0), ``start`` (its first word), ``n_tokens``, ``shard`` and ``bin``.

    (shard, bin) names a bin; its pieces have at most ``capacity`` tokens (words) together, no source twice and no copy
    twice; with ``near_copies`` no two texts of a class of ``near_classes``, either (sketches: a near copy may be missed). A text of k * capacity + r words has k full pieces, each alone in its bin, and one of r words unless r is 0.
    A null or empty text has one piece of 0 tokens. A null source conflicts with nothing; rows with null ids are packed
    like others. Repeated rows are copies, so each lies in a bin of its own. Other columns are not read; an empty table
    gives no rows. Ties of size are taken by a hash of id and text, so the result does not depend on row order.
    """
    if capacity < 1 or shard < 1:
        raise ValueError("capacity and shard must be positive")
    kind = docs.schema[id].dataType.simpleString()
    told = written(pieces(docs, id, text, source), "pieces")
    shards = max(1, -(-told.count() // shard))
    # Equal rows are counted and dealt in turn, so that a row repeated very often is spread over the shards.
    turn = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))
    told = told.groupBy(*told.columns).agg(F.count("*").alias("_n"))
    if near_copies:
        keyed = docs.select(F.xxhash64(id, text).alias("order"), F.col(text).alias("text"))
        told = told.join(near_classes(keyed, "order", "text").dropDuplicates(["order"]), "order", "left")
    else:
        told = told.withColumn("class", F.lit(None).cast("long"))
    dealt = told.withColumn("_turn", turn).withColumn("shard", F.pmod(F.hash("order") + F.col("_turn"), F.lit(shards)).cast("long"))
    dealt = dealt.select(id, "n_tokens", "source", "copies", "order", "class", "shard")

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("n_tokens", "descending"), ("order", "ascending"), (id, "ascending")])
        size = rows.column("n_tokens").to_numpy()
        full, rest = size // capacity, size % capacity
        packed = np.flatnonzero((rest > 0) | (size == 0))
        groups = [rows.column(c).take(packed).to_pylist() for c in ("source", "copies", "class")]
        where = pack(rest[packed].tolist(), *groups[:2], capacity, groups[2])
        opened = max(where, default=-1) + 1
        row = np.r_[packed, np.repeat(np.arange(len(size)), full)]
        piece = np.r_[full[packed], np.arange(full.sum()) - np.repeat(np.cumsum(full) - full, full)]
        tokens = np.r_[rest[packed], np.full(full.sum(), capacity)]
        bins = np.r_[np.array(where, np.int64), opened + np.arange(full.sum())]
        return pa.table(
            {
                id: rows.column(id).take(row), "piece": piece, "start": piece * capacity, "n_tokens": tokens,
                "shard": rows.column("shard").take(row), "bin": bins,
            }
        )

    return dealt.groupBy("shard").applyInArrow(
        run, f"{id} {kind}, piece long, start long, n_tokens long, shard long, bin long"
    )
