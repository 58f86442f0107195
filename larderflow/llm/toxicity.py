"""Toxicity by weak supervision: many voters, a generative label model over their votes, a linear classifier.

1. Terms (words and word beginnings of four letters) that labelled toxic texts have and other labelled texts do not are
   dealt out to several lexicons; each lexicon is a voter, as are a fixed list of insults and some patterns.
2. The label model is fitted to the votes on all texts: a hidden class, the rate at which each voter fires in each class
   and, from what two voters share within a class, their correlation; correlated voters share their weight. A known
   label is one more voter, whose accuracy is estimated like the others'.
3. A logistic regression over terms and votes learns the posterior labels of the sample, and scores every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larderflow.llm import text as tx
from larderflow.llm.quality import fold
from larderflow.session import written

FOLDS = 4
HELD_OUT = 2
CUT = 0.3
# Labelled rows whose terms are looked at, at most: those with the smallest hash of their id.
SAMPLE = 12_000
LEXICONS = 6
LEXICON_TERMS = 3_000
# Terms the linear classifier has a weight for, at most.
WEIGHTS = 40_000
# Share of toxic texts among those that have a lexicon term, at least.
PRECISION = 0.9
STEPS = 150

# Common English insults.
INSULTS = ("idiot", "moron", "stupid", "dumb", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "clown", "fool", "jerk", "imbecile")
# Signs written for letters.
DISGUISE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

VOTERS = (*[f"lexicon_{k}" for k in range(LEXICONS)], "insults", "disguised", "repeated", "dense", "shouted")

_BREAK = np.ones(256, bool)
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_DISGUISE_BREAK = _BREAK.copy()
_DISGUISE_BREAK[[ord(c) for c in DISGUISE]] = False
_UNDISGUISED = tx.LOWER.copy()
for _sign, _letter in DISGUISE.items():
    _UNDISGUISED[ord(_sign)] = ord(_letter)


def _lower(data: np.ndarray) -> np.ndarray:
    """A-Z and the capitals of Latin-1 (two bytes in UTF-8) in lower case."""
    out = tx.LOWER[data]
    second = np.flatnonzero(data[:-1] == 0xC3) + 1
    second = second[(data[second] >= 0x80) & (data[second] <= 0x9E) & (data[second] != 0x97)]
    out[second] += 0x20
    return out


def _hash_of(words: tuple[str, ...]) -> np.ndarray:
    data, offsets = tx.utf8(pa.array(words))
    return np.sort(tx.span_hashes(data, offsets[:-1], offsets[1:]))


class Terms:
    """Hashes of all terms of a slice of texts, and which text each stands in."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets = data, offsets
        self.low = _lower(data)
        self.starts, self.ends, self.at = tx.words(self.low, offsets, _BREAK)
        self.owner = np.repeat(np.arange(len(offsets) - 1), np.diff(self.at))
        letters = np.flatnonzero((data & 0xC0) != 0x80)
        place = np.searchsorted(letters, self.starts) + 4
        letters = np.r_[letters, np.full(5, len(data))]
        self.words = tx.span_hashes(self.low, self.starts, self.ends)
        heads = tx.span_hashes(self.low, self.starts, np.minimum(letters[place], self.ends))
        self.heads = tx.mix(heads + np.uint64(1))

    def votes(self, lexicon: Table) -> np.ndarray:
        """One bit per voter that fires, for each text."""
        n = len(self.offsets) - 1
        mask = np.zeros(n, np.int64)
        hits = np.zeros(n, np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for hashes in (self.words, self.heads):
            place = lexicon.find(hashes)
            hit = np.flatnonzero(place >= 0)
            own, slot = self.owner[hit], place[hit]
            np.bitwise_or.at(mask, own, np.int64(1) << lexicon.values[slot].astype(np.int64))
            np.add.at(hits, own, 1)
            found.append((own, slot))
        own, slot = (np.concatenate(x) for x in zip(*found, strict=True))
        kinds = np.unique(np.stack([own, slot], 1), axis=0)[:, 0] if len(own) else own
        different = np.bincount(kinds, minlength=n)
        words = np.maximum(np.diff(self.at), 1)
        insult = np.isin(self.words, _INSULT_HASHES)
        insults = np.bincount(self.owner[insult], minlength=n)
        fired = {"insults": insults > 0, "disguised": self._disguised(), "repeated": different >= 3, "dense": hits >= 0.02 * words, "shouted": self._shouted()}
        for name, flags in fired.items():
            mask |= flags.astype(np.int64) << VOTERS.index(name)
        return mask

    def _disguised(self) -> np.ndarray:
        """An insult once signs are read as letters, in a word that is written with such signs."""
        plain = _UNDISGUISED[self.data]
        starts, ends, at = tx.words(self.low, self.offsets, _DISGUISE_BREAK)
        signs = np.cumsum(np.r_[0, plain != self.low])
        odd = np.flatnonzero(signs[ends] > signs[starts])
        hit = odd[np.isin(tx.span_hashes(plain, starts[odd], ends[odd]), _INSULT_HASHES)]
        return np.bincount(np.searchsorted(at, hit, "right") - 1, minlength=len(at) - 1) > 0

    def _shouted(self) -> np.ndarray:
        """More than 2 exclamation marks for 100 words."""
        marks = np.cumsum(np.r_[0, self.data == 33])[self.offsets]
        return np.diff(marks) > np.maximum(2, 0.02 * np.diff(self.at))


class Table:
    """Values of at most some ten thousand hashed terms, looked up by array access."""

    BITS = 20

    def __init__(self, hashes: np.ndarray, values: np.ndarray) -> None:
        slots = (hashes >> np.uint64(64 - self.BITS)).astype(np.int64)
        self.slots = np.full(1 << self.BITS, -1, np.int32)
        self.slots[slots[::-1]] = np.arange(len(hashes), dtype=np.int32)[::-1]  # of two terms in a slot the first stays
        self.hashes, self.values = np.append(hashes, np.uint64(0)), values

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The index of each term, -1 for others."""
        place = self.slots[(hashes >> np.uint64(64 - self.BITS)).astype(np.int64)]
        return np.where(self.hashes[place] == hashes, place, -1)


_INSULT_HASHES = _hash_of(INSULTS)


def _terms(column: pa.Array) -> Iterator[Terms]:
    data, offsets = tx.utf8(column)
    for i, j in tx.slices(offsets):
        yield Terms(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def _sample_terms(docs: DataFrame, sample: dict, id: str, text: str) -> tuple[list, np.ndarray, list[np.ndarray]]:
    """Ids and labels of the sampled texts and the distinct term hashes of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            chosen = [k for k, one in enumerate(ids) if one in sample]
            if not chosen:
                continue
            rows = []
            for terms in _terms(batch.column(1).take(pa.array(chosen))):
                for a, b in zip(terms.at[:-1].tolist(), terms.at[1:].tolist(), strict=True):
                    rows.append(np.unique(np.r_[terms.words[a:b], terms.heads[a:b]]).tobytes())
            truth = pa.array([sample[ids[k]] for k in chosen], pa.float64())
            yield pa.record_batch([batch.column(0).take(pa.array(chosen)), truth, pa.array(rows, pa.binary())], [id, "label", "terms"])

    kind = docs.schema[id].dataType.simpleString()
    got = docs.select(id, text).mapInArrow(run, f"{id} {kind}, label double, terms binary").toArrow()
    got = got.sort_by([(id, "ascending"), ("terms", "ascending")])  # sums are the same in every run
    return got.column(id).to_pylist(), got.column("label").to_numpy(), [np.frombuffer(t, np.uint64) for t in got.column("terms").to_pylist()]


def family_weights(terms: list[np.ndarray]) -> np.ndarray:
    """1 over the number of near copies of each sampled text, so that a text copied often tells no more than another.

    Near copies have the same minima of six hashes of their terms, in any of six such bands. Terms that more than a
    twentieth of the texts have say nothing of copies and are left out.
    """
    if not terms:
        return np.zeros(0)
    known, counts = np.unique(np.concatenate(terms), return_counts=True)
    usual = known[counts > max(2, len(terms) / 20)]
    root = list(range(len(terms)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    salts = tx.mix(np.arange(1, 37, dtype=np.uint64))
    seen: dict[tuple, int] = {}
    for k, own in enumerate(terms):
        rare = np.setdiff1d(own, usual, assume_unique=True)
        if len(rare):
            least = np.array([tx.mix(rare ^ salt).min() for salt in salts]).reshape(6, 6)
            for band, minima in enumerate(least):
                root[find(k)] = find(seen.setdefault((band, minima.tobytes()), k))
    members = [find(k) for k in range(len(terms))]
    return 1 / np.bincount(members, minlength=len(terms))[members]


def _associated(labels: np.ndarray, terms: list[np.ndarray], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms of two or more sampled texts, with the weight of toxic and of other texts that have them."""
    if not terms:
        return np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)
    owner = np.repeat(np.arange(len(terms), dtype=np.int32), [len(t) for t in terms])
    flat = np.concatenate(terms)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, np.int64)
    if not len(first):
        return flat, np.zeros(0), np.zeros(0)
    toxic = np.add.reduceat((weights * (labels > 0.5))[owner], first)
    clean = np.add.reduceat((weights * (labels <= 0.5))[owner], first)
    often = np.diff(np.r_[first, len(flat)]) > 1
    return flat[first][often], toxic[often], clean[often]


def lexicons(labels: np.ndarray, terms: list[np.ndarray], weights: np.ndarray) -> tuple[Table, np.ndarray, np.ndarray]:
    """The lexicon voters' terms, and the terms worth a weight in the classifier with their log odds.

    A term counts if its likelihood ratio against no association at all is beyond what the best of so many unassociated
    terms reaches by chance once in ten times; lexicon terms are those that nearly only toxic texts have.
    """
    hashes, a, b = _associated(labels, terms, weights)
    n1, n0 = (max(1e-9, float(weights[side].sum())) for side in (labels > 0.5, labels <= 0.5))
    odds = np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1))
    total, rate = a + b, n1 / (n1 + n0)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 2 * (np.where(a > 0, a * np.log(a / (total * rate)), 0) + np.where(b > 0, b * np.log(b / (total * (1 - rate))), 0))
    sure = ratio > 2 * np.log(max(len(hashes), 1) / 0.1)
    strong = np.flatnonzero(sure & (a >= PRECISION * total))
    strong = strong[np.lexsort((hashes[strong], -a[strong]))][:LEXICON_TERMS]
    lexicon = Table(hashes[strong], np.arange(len(strong)) % LEXICONS)
    chosen = np.flatnonzero(sure)
    chosen = chosen[np.lexsort((hashes[chosen], -ratio[chosen]))][:WEIGHTS]
    return lexicon, hashes[chosen], odds[chosen]


class LabelModel:
    """Rates of firing of each voter in the two classes, and the weight that correlation leaves to it."""

    def __init__(self, masks: np.ndarray, gold: np.ndarray, counts: np.ndarray, rounds: int = 25) -> None:
        """Fit to vote patterns: bit masks, known label (-1: none) and number of texts with the pattern."""
        votes = (masks[:, None] >> np.arange(len(VOTERS))) & 1
        known = gold >= 0
        self.weights = np.ones(len(VOTERS))
        started = np.where(known, gold == 1, votes[:, :LEXICONS].sum(1) >= 2).astype(float)
        for k in range(rounds):
            belief = started if k == 0 else self._posterior(votes, gold)
            self._estimate(votes, gold, counts, belief)
            if k == rounds // 2:
                self._share_weights(votes, counts, belief)

    def _estimate(self, votes, gold, counts, belief) -> None:
        toxic, clean = counts * belief, counts * (1 - belief)
        self.prior = (toxic.sum() + 1) / (counts.sum() + 2)
        self.fire = np.stack([(clean @ votes + 0.5) / (clean.sum() + 1), (toxic @ votes + 0.5) / (toxic.sum() + 1)])
        known = gold >= 0
        said = (gold == 1).astype(float)
        self.said = np.array([((w * said)[known].sum() + 0.5) / (w[known].sum() + 10) for w in (clean, toxic)])
        self.said[1] = max(self.said[1], 0.98)  # labels are seldom wrong
        self.said[0] = min(self.said[0], 0.005)

    def _share_weights(self, votes, counts, belief) -> None:
        """A voter's weight is 1 over the sum of its correlations within the classes."""
        shared = np.zeros((len(VOTERS), len(VOTERS)))
        for c, w in enumerate((counts * (1 - belief), counts * belief)):
            apart = votes - self.fire[c]
            cov = (apart * w[:, None]).T @ apart / max(w.sum(), 1)
            spread = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            shared = np.maximum(shared, np.where(w.sum() > 0, cov / np.outer(spread, spread), 0))
        np.fill_diagonal(shared, 1)
        shared[shared < 0.1] = 0
        self.correlations = shared
        self.weights = 1 / shared.sum(1)

    def _posterior(self, votes: np.ndarray, gold: np.ndarray) -> np.ndarray:
        fired = np.log(self.fire[1] / self.fire[0]) * self.weights
        silent = np.log((1 - self.fire[1]) / (1 - self.fire[0])) * self.weights
        total = np.log(self.prior / (1 - self.prior)) + votes @ fired + (1 - votes) @ silent
        total += np.where(gold == 1, np.log(self.said[1] / self.said[0]), 0)
        total += np.where(gold == 0, np.log((1 - self.said[1]) / (1 - self.said[0])), 0)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))

    def linear(self, n_terms: int) -> tuple[np.ndarray, np.ndarray, float]:
        """The posterior as weights of votes alone, for want of sampled texts."""
        fired, silent = np.log(self.fire[1] / self.fire[0]), np.log((1 - self.fire[1]) / (1 - self.fire[0]))
        base = float(np.log(self.prior / (1 - self.prior)) + (silent * self.weights).sum())
        return np.zeros(n_terms), (fired - silent) * self.weights, base

    def posterior(self, masks: np.ndarray, gold: np.ndarray) -> np.ndarray:
        return self._posterior((masks[:, None] >> np.arange(len(VOTERS))) & 1, gold)


def _regression(
    rows: list[np.ndarray], masks: np.ndarray, belief: np.ndarray, share: np.ndarray, start: np.ndarray
) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of terms and votes and the intercept: penalised logistic loss against the posterior labels.

    ``share`` weighs the texts; terms start at a tenth of their log odds.
    """
    n_terms, share = len(start), share / share.sum()
    votes = ((masks[:, None] >> np.arange(len(VOTERS))) & 1).astype(float)
    sizes = np.array([len(r) for r in rows])
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), sizes)
    weights, by_vote = 0.1 * start, np.zeros(len(VOTERS))
    rate = np.clip(belief @ share, 1e-3, 1 - 1e-3)
    base = float(np.log(rate / (1 - rate)))
    seen = [np.full(n_terms, 1e-8), np.full(len(VOTERS), 1e-8), 1e-8]
    for _ in range(STEPS):
        total = base + np.bincount(owner, weights[flat], len(rows)) + votes @ by_vote
        error = (1 / (1 + np.exp(-np.clip(total, -30, 30))) - belief) * share
        slopes = [np.bincount(flat, error[owner], n_terms) + 2e-6 * weights, error @ votes + 1e-5 * by_vote, error.sum()]
        seen = [s + d * d for s, d in zip(seen, slopes, strict=True)]
        weights = weights - 0.3 * slopes[0] / np.sqrt(seen[0])
        by_vote = by_vote - 0.3 * slopes[1] / np.sqrt(seen[1])
        base -= 0.3 * slopes[2] / np.sqrt(seen[2])
    return weights, by_vote, float(base)


class Scorer:
    """What scoring a text takes: the lexicons, the weights of terms and votes, and the intercept."""

    def __init__(self, lexicon: Table, terms: Table, weights: np.ndarray, by_vote: np.ndarray, base: float) -> None:
        self.lexicon, self.terms, self.weights, self.by_vote, self.base = lexicon, terms, weights, by_vote, base

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Score and votes of each text."""
        totals, fired = [np.zeros(0)], [np.zeros(0, np.int64)]
        for t in _terms(column):
            mask = t.votes(self.lexicon)
            total = self.base + ((mask[:, None] >> np.arange(len(VOTERS))) & 1) @ self.by_vote
            places = [self.terms.find(h) for h in (t.words, t.heads)]
            owner, place = (np.concatenate(x) for x in zip(*[(t.owner[p >= 0], p[p >= 0]) for p in places], strict=True))
            if len(owner):
                keys = np.unique(owner * len(self.weights) + place)
                total += np.bincount(keys // len(self.weights), self.weights[keys % len(self.weights)], len(mask))
            totals.append(1 / (1 + np.exp(-np.clip(total, -30, 30))))
            fired.append(mask)
        return np.concatenate(totals), np.concatenate(fired)


def trained(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic") -> Scorer:
    """Lexicons from a sample of labelled texts, the label model from the votes on all texts, the classifier from both."""
    kind = docs.schema[id].dataType.simpleString()
    known = labels.select(id, F.col(label).cast("double").alias("_label")).filter(F.col("_label").isNotNull())
    known = known.filter(fold(id, FOLDS) != HELD_OUT).groupBy(id).agg(F.max("_label").alias("_label"))
    chosen = known.join(docs.select(id), id, "left_semi").orderBy(F.xxhash64(id), id).limit(SAMPLE)
    sample = {r[0]: r[1] for r in chosen.collect()}
    ids, truth, terms = _sample_terms(docs, sample, id, text)
    share = family_weights(terms)
    lexicon, hashes, odds = lexicons(truth, terms, share)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks = [np.zeros(0, np.int64), *[t.votes(lexicon) for t in _terms(batch.column(1))]]
            yield pa.record_batch([batch.column(0), pa.array(np.concatenate(masks))], [id, "votes"])

    cast = written(docs.select(id, text).mapInArrow(vote, f"{id} {kind}, votes long"), "votes")
    patterns = cast.join(known, id, "left").groupBy("votes", "_label").count().toArrow()  # at most 3 * 2 ** voters rows
    patterns = patterns.sort_by([("votes", "ascending"), ("_label", "ascending")])
    gold = np.nan_to_num(patterns.column("_label").to_numpy().astype(float), nan=-1)
    gold = np.where(gold < 0, -1, gold > 0.5)
    model = LabelModel(patterns.column("votes").to_numpy(), gold, patterns.column("count").to_numpy().astype(float))

    table = Table(hashes, odds)
    if not ids:
        return Scorer(lexicon, table, *model.linear(len(hashes)))
    votes = {r[0]: r[1] for r in cast.join(chosen.select(id), id).select(id, "votes").collect()}  # at most the sample
    masks = np.array([votes[k] for k in ids], np.int64)
    belief = model.posterior(masks, np.where(truth > 0.5, 1, 0))
    rows = [np.unique(p[p >= 0]) for p in map(table.find, terms)]
    return Scorer(lexicon, table, *_regression(rows, masks, belief, share, odds))


def score(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """One row per row of ``docs``: id, ``held_out``, ``score`` (0 to 1, higher: more likely toxic), ``predicted`` (0 or
    1) and ``votes``, the bits of the ``VOTERS`` that fired.

    Labels are learnt from rows outside the held-out fold; terms from at most ``SAMPLE`` of them, votes from all texts.
    Scores depend on the text alone. Null and empty texts have no terms and no votes, and get the score that leaves.
    Rows with a null id are scored, count as not held out and are never learnt from; null labels are not learnt from
    either. Repeated rows all come back. Very long texts are read whole, and equal texts have equal scores. Without any
    label the fixed insults and patterns still vote. Other columns are not read, and an empty table gives no rows.
    """
    scorer = trained(docs, labels, id, text, label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, votes = scorer(batch.column(1))
            yield pa.record_batch([batch.column(0), pa.array(scores), pa.array(votes)], [id, "score", "votes"])

    kind = docs.schema[id].dataType.simpleString()
    scored = docs.select(id, text).mapInArrow(run, f"{id} {kind}, score double, votes long")
    held = F.coalesce(fold(id, FOLDS) == HELD_OUT, F.lit(False))
    return scored.select(id, held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "votes")


def accepted(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores below ``CUT``; see ``score`` for odd rows."""
    scorer = trained(docs, labels, id, text, label)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(scorer(batch.column(place))[0] < CUT))

    return docs.mapInArrow(run, docs.schema)
