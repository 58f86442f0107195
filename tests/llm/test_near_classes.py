from __future__ import annotations

import random
from collections import Counter

import numpy as np

from larderflow.llm import near_classes, ngram_join

SCHEMA = "doc_id long, text string, class long, digest int"
SF_DIR = "/root/testdata/sf0.01"


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.75, 0.9, 1.0):
        agreed = []
        for size in (30, 200, 3000):
            for _ in range(60):
                both = rng.integers(0, 2**64, int(size * share) or 1, np.uint64)
                apart = [rng.integers(0, 2**64, (size - len(both)) // 2, np.uint64) for _ in range(2)]
                one, other = (near_classes.sketch(np.unique(np.r_[both, x])) for x in apart)
                agreed.append((one == other).mean())
        assert abs(np.mean(agreed) - share) < 0.06
    assert len(near_classes.sketch(np.array([5], np.uint64))) == near_classes.BINS


def test_rows_of_all_kinds(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(400)]
    base = rng.choices(words, k=200)
    near = [[*base[:k], "x", *base[k + 1 :]] for k in (3, 100, 199)]
    rows = [(10 + k, " ".join(t)) for k, t in enumerate([base, *near])] + [(20 + k, " ".join(rng.choices(words, k=150))) for k in range(30)]
    rows += [(60, None), (61, ""), (62, " \n"), (None, "five words of a text"), (63, "Few words"), (64, "few  WORDS"), (65, "few other words"), (20, rows[4][1])]
    rows += [(70 + k, "the same text in very many rows") for k in range(300)] + [(400, "long " * 50_000)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)
    found = near_classes.near_classes(docs).collect()
    by = {r.doc_id: r["class"] for r in found}
    assert len(found) == len([1 for i, t in rows if i is not None and (t or "").split()])
    assert {by[k] for k in (10, 11, 12, 13)} == {10} and by[63] == by[64] == 63 and by[65] == 65
    assert all(by[k] == k for k in range(20, 50)) and {by[k] for k in range(70, 370)} == {70} and by[400] == 400
    assert near_classes.near_classes(docs.limit(0)).collect() == []


def test_recall_of_exact_links_on_the_corpus(spark):
    """Of all pairs of texts that the exact join puts into one class, at least 0.9 are in one class here.

    Pairs of less similarity may come on top (a third of the pairs here): they keep two texts out of one bin, no more.
    """
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    near = {r.doc_id: r["class"] for r in near_classes.near_classes(docs).collect()}
    exact = {r.doc_id: r.component_id for r in ngram_join.jaccard_classes(docs).collect()}
    pairs = lambda sizes: sum(n * (n - 1) // 2 for n in sizes)
    same = pairs(Counter((exact[i], near[i]) for i in near).values())
    linked, tied = pairs(Counter(exact[i] for i in near).values()), pairs(Counter(near.values()).values())
    print(f"recall {same / linked:.4f}, precision {same / tied:.4f} of {linked} pairs")
    assert same >= 0.9 * linked and same >= 0.5 * tied
