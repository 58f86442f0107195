"""BPE encoding and decoding of texts with a vocabulary of lower-case words (a tokenizer file of the ``tokenizers`` library).

A text is split at the special tokens of the file, normalised (NFC, lower case) and cut into words: contractions, runs of
letters, single digits, runs of other signs; white space is dropped. Each new word is merged by a contiguous rank array: the
ids of its parts stand side by side, beside them the rank of every adjacent pair. The smallest rank (the leftmost of equal
ones) is looked for by a scan, the boundary it stands for is deleted, so both arrays get one shorter, and the ranks of the
two new neighbours are looked up again, until no pair has a rank. New words are merged side by side: each round deletes one
boundary of every word that is not done. Words of more than ``SHORT`` bytes would make the scan quadratic; they keep their
boundaries in a linked list and the ranks in a heap, which gives the same merges.

Rows are independent: nothing is shuffled, a lost task is simply run again. A task holds one text and the ids of about
``SLICE`` characters at a time, and remembers the ids of at most two times ``KNOWN_WORDS`` words.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator, Sequence
from functools import cache, cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
# Words of more bytes are merged with a heap.
SHORT = 64
# Words merged side by side, characters of text and ids worked on at a time.
SIDE_BY_SIDE = 4096
SLICE = 1 << 20
# Words whose ids a task remembers, and as many of those used before them.
KNOWN_WORDS = 100_000
NONE = np.iinfo(np.int32).max


def byte_signs() -> list[str]:
    """The sign that stands for each byte in the vocabulary: itself if it can be printed, else one from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = (b for b in range(256) if b not in set(shown))
    signs = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return [signs[b] for b in range(256)]


class Vocabulary:
    """Ranks and ids of a tokenizer file with byte signs and a mark at the end of words."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as handle:
            whole = json.load(handle)
        model = whole["model"]
        ids, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {token["content"]: token["id"] for token in whole["added_tokens"]}
        self.cuts = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        said = ids | self.special
        self.said = [""] * (max(said.values()) + 1)
        for token, k in said.items():
            self.said[k] = token
        signs = byte_signs()
        self.inner = np.array([ids[s] for s in signs], np.int64)
        self.last = np.array([ids[s + end] for s in signs], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
        self.rank_of = np.argsort(keys)
        self.keys = keys[self.rank_of]
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, NONE if they are never merged; ids of -1 stand for nothing."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (right >= 0), self.rank_of[at], NONE)

    def merge_side_by_side(self, words: Sequence[bytes]) -> list[tuple[int, ...]]:
        """The ids of short words by contiguous rank arrays, one row for each word."""
        lengths = np.array([len(w) for w in words])
        parts = np.full((len(words), lengths.max()), -1, np.int64)
        inside = np.arange(parts.shape[1]) < lengths[:, None]
        data = np.frombuffer(b"".join(words), np.uint8)
        parts[inside] = self.inner[data]
        parts[np.arange(len(words)), lengths - 1] = self.last[data[np.cumsum(lengths) - 1]]
        ranks = self.ranks(parts[:, :-1], parts[:, 1:])
        rows, left = np.arange(len(words)), lengths
        out: list[tuple[int, ...]] = [()] * len(words)
        while len(rows):
            if ranks.shape[1]:
                at = ranks.argmin(1)
                best = ranks[np.arange(len(rows)), at]
            else:
                at = best = np.full(len(rows), NONE)
            going = best != NONE
            for row, ids, n in zip(rows[~going].tolist(), parts[~going].tolist(), left[~going].tolist(), strict=True):
                out[row] = tuple(ids[:n])
            rows, parts, ranks, left = rows[going], parts[going], ranks[going], left[going] - 1
            at, best = at[going], best[going]
            every, cut = np.arange(len(rows)), at[:, None]
            parts[every, at] = self.merged[best]
            columns = np.arange(parts.shape[1] - 1)
            parts = np.take_along_axis(parts, columns + (columns > cut), 1)
            columns = columns[:-1]
            ranks = np.take_along_axis(ranks, columns + (columns >= cut), 1)
            follows = at < ranks.shape[1]
            some, here = every[follows], at[follows]
            ranks[some, here] = self.ranks(parts[some, here], parts[some, here + 1])
            some, here = every[at > 0], at[at > 0]
            ranks[some, here - 1] = self.ranks(parts[some, here - 1], parts[some, here])
        return out

    @cached_property
    def pairs(self) -> dict[int, int]:
        return dict(zip(self.keys.tolist(), self.rank_of.tolist(), strict=True))

    def merge_long(self, word: bytes) -> tuple[int, ...]:
        """The ids of one word of any length with a heap of ranks and linked parts."""
        ids = [*self.inner[list(word[:-1])].tolist(), int(self.last[word[-1]])]
        n, pairs, merged = len(ids), self.pairs, self.merged
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k) for k in range(n - 1) if (r := pairs.get(ids[k] << 32 | ids[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, k = heapq.heappop(heap)
            other = after[k]
            if ids[k] < 0 or other >= n or pairs.get(ids[k] << 32 | ids[other]) != rank:
                continue
            ids[k], ids[other], after[k] = int(merged[rank]), -1, after[other]
            if after[k] < n:
                before[after[k]] = k
            for one in (before[k], k):
                if one >= 0 and after[one] < n and (r := pairs.get(ids[one] << 32 | ids[after[one]])) is not None:
                    heapq.heappush(heap, (r, one))
        return tuple(k for k in ids if k >= 0)

    def merge(self, words: Sequence[str]) -> None:
        """Learn the ids of words that are not known yet."""
        coded = sorted(((w, w.encode("utf-8", "replace")) for w in words), key=lambda x: len(x[1]))
        short = [x for x in coded if len(x[1]) <= SHORT]
        for start in range(0, len(short), SIDE_BY_SIDE):
            some = short[start : start + SIDE_BY_SIDE]
            self.known.update(zip((w for w, _ in some), self.merge_side_by_side([b for _, b in some]), strict=True))
        self.known.update((w, self.merge_long(b)) for w, b in coded[len(short) :])

    def words(self, text: str) -> list[str]:
        """The words of a text and its special tokens, in order."""
        if self.cuts is None or not self.cuts.search(text):
            return WORDS.findall(lowered(text))
        found: list[str] = []
        start = 0
        for cut in self.cuts.finditer(text):
            found += [*WORDS.findall(lowered(text[start : cut.start()])), cut.group()]
            start = cut.end()
        return found + WORDS.findall(lowered(text[start:]))

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts and the n + 1 offsets of the texts in them."""
        split = [self.words(t) for t in texts]
        wanted = set().union(*split)
        if len(self.known) > KNOWN_WORDS:
            self.known, self.older = {}, self.known
        new = wanted - self.known.keys()
        self.known.update((w, self.older[w]) for w in new & self.older.keys())
        self.known.update((w, (k,)) for w, k in self.special.items())
        self.merge([w for w in new if w not in self.known])
        ids, ends = array("i"), [0]
        for words in split:
            ids.extend(chain.from_iterable(map(self.known.__getitem__, words)))
            ends.append(len(ids))
        return np.frombuffer(ids, np.int32) if ids else np.zeros(0, np.int32), np.array(ends, np.int32)


def lowered(text: str) -> str:
    """NFC and lower case sign by sign, so a capital sigma does not depend on its place in the word."""
    return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about SLICE each; one larger row is a range of its own."""
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        base = ends[start] - sizes[start]
        stop = max(start + 1, int(np.searchsorted(ends, base + SLICE, "right")))
        yield start, stop
        start = stop


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the column ``ids``: the array of ids of the whole text, no special tokens added.

    ``path`` names the tokenizer file, which every executor must have. A null or empty text, or one of white space only, has
    no ids; repeated rows and rows with a null id stay as they are; a column of the name ``ids`` is replaced, other columns
    are kept; an empty table stays empty. Ids equal those of the library for all characters that Python's Unicode tables
    assign; of younger ones the library and Python may tell letters from other signs differently.
    """
    kept = docs.drop(ids)
    at = kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = vocabulary(path)
        for batch in batches:
            texts = pc.fill_null(batch.column(at), "")
            for start, stop in _slices(pc.utf8_length(texts).to_numpy(zero_copy_only=False)):
                flat, ends = held.encode(texts.slice(start, stop - start).to_pylist())
                found = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                part = batch.slice(start, stop - start)
                yield pa.record_batch([*part.columns, found], [*part.schema.names, ids])

    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField(ids, ArrayType(IntegerType()))]))


def decode(encoded: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``encoded`` with the column ``decoded``: the tokens that the ids stand for, special ones too, joined by one space.

    The file has no decoder, so ends of words and byte signs stay as they are in the vocabulary. Null or empty ids give an
    empty text, null entries and ids outside of the vocabulary give nothing.
    """
    kept = encoded.drop(decoded)
    at = kept.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said = pa.array(vocabulary(path).said)
        for batch in batches:
            lists = batch.column(at)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            for start, stop in _slices(sizes):
                part = batch.slice(start, stop - start)
                flat = part.column(at).flatten().cast(pa.int64()).to_numpy(zero_copy_only=False)
                good = (flat >= 0) & (flat < len(said))
                ends = np.r_[0, np.cumsum(good)][np.r_[0, np.cumsum(sizes[start:stop])]]
                tokens = said.take(pa.array(flat[good].astype(np.int64)))
                texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), tokens), " ")
                yield pa.record_batch([*part.columns, texts], [*part.schema.names, decoded])

    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField(decoded, StringType())]))
