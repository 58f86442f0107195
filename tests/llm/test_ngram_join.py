from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from larderflow.llm import ngram_join
from larderflow.llm.components import components

SCHEMA = "doc_id long, text string, sid string, n int, component string"


def shingles(text, size=5):
    lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    for c in "\t\n\x0b\x0c\r":
        lower = lower.replace(c, " ")
    words = [w for w in lower.split(" ") if w]
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)}


def brute_force(rows, threshold=75):
    """(doc_id, n_shingles, component_id) of rows (doc_id, text), by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= threshold * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    least = {}
    for k, (one, _) in enumerate(rows):
        if one is not None:
            least[find(k)] = min(one, least.get(find(k), one))
    return [(one, len(s), least.get(find(k))) for k, ((one, _), s) in enumerate(zip(rows, sets, strict=True))]


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}é" for k in range(300)]
    texts = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(1, 60))]
        for _ in range(rng.randint(1, 12)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 12))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(rng.choice([" ", "\n", "  "]).join(w.upper() if rng.random() < 0.1 else w for w in copy))
    rng.shuffle(texts)
    return list(enumerate(texts))


def answer(spark, rows, **options):
    table = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA)
    return ngram_join.jaccard_classes(table, **options)


def key(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2] is None, r[2] or 0))


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE_TOKENS", 150)  # several tiles in a cluster
    rows = [(i, t.replace("É", "é")) for i, t in corpus(1)]
    assert key(map(tuple, answer(spark, rows).collect())) == key(brute_force(rows))


def test_nulls_empty_long_and_repeated_rows(spark):
    long = " ".join(f"t{k}" for k in range(30_000))
    rows = [(5, None), (6, ""), (7, " \n\t"), (None, "a b c d e f"), (9, "A b  c d\te f"), (9, "A b  c d\te f"), (3, "one two"),
            (4, "one  TWO"), (2, "two one"), (None, None), (None, "only here"), (11, long), (10, long + " end")]
    result = answer(spark, rows)
    assert result.columns == ["doc_id", "n_shingles", "component_id"]
    assert key(map(tuple, result.collect())) == key(brute_force(rows))
    assert answer(spark, []).collect() == []
    kept = ngram_join.distinct_texts(spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA))
    assert kept.columns == ["doc_id", "text", "sid", "n", "component"]
    found = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    wanted = [(5, None), (6, ""), (7, " \n\t"), (None, None), (9, rows[4][1]), (3, "one two"), (2, "two one"), (None, "only here"), (10, rows[-1][1])]
    assert found == sorted(wanted, key=str)


def test_common_tokens_go_to_their_sets(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "RARITY", 3)
    rng = random.Random(3)
    base = [f"b{k}" for k in range(40)]
    rows = [(k, " ".join(w if rng.random() > 0.03 else f"r{rng.randrange(9)}" for w in base)) for k in range(1300)]
    result = answer(spark, rows)
    assert key(map(tuple, result.collect())) == key(brute_force(rows))


def test_equal_sets_have_equal_digests():
    texts = ["a b c d e f", "A  B c\nd e F", "a b c d e g", None, ""]
    sets, digests = next(ngram_join.shingle_sets(pa.array(texts)))
    assert digests[0] == digests[1] != digests[2]
    assert [len(s) for s in sets] == [2, 2, 2, 0, 0] and digests[3] == digests[4]


def test_common_counts():
    rng = np.random.default_rng(0)
    sides = []
    for _ in range(2):
        sets = [np.unique(rng.integers(0, 60, rng.integers(0, 20))) for _ in range(7)]
        sides.append(sets)
    packed = [(np.array([len(s) for s in side]), np.concatenate(side).astype(np.int64)) for side in sides]
    counted = ngram_join._common_counts(*packed)
    assert (counted == [[len(np.intersect1d(a, b)) for b in sides[1]] for a in sides[0]]).all()


@pytest.mark.parametrize("links", [[], [(1, 1)], [(k + 1, k) for k in range(40)], [(k, 99) for k in range(30)] + [(200, 201)]])
def test_components(spark, links):
    found = components(spark.createDataFrame(links, "u long, v long"))
    root = {}
    for u, v in links:
        if u != v:
            a, b = {*root.get(u, {u})}, {*root.get(v, {v})}
            for k in a | b:
                root[k] = a | b
    assert sorted(map(tuple, found.collect())) == sorted((k, min(c)) for k, c in root.items())
