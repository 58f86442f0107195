from __future__ import annotations

import random
from collections import defaultdict

import pytest

from larderflow.llm import packing

SCHEMA = "doc_id long, text string, source string, bin int, shard int, copies int, order int"


def plain_best_fit(sizes, sources, copies, capacity):
    """The same rule, looking at all bins for each piece."""
    bins, where = [], [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        fits = [
            (left, n) for n, (left, s, c) in enumerate(bins)
            if left >= sizes[k] and (sources[k] is None or sources[k] not in s) and (copies[k] is None or copies[k] not in c)
        ]
        if fits:
            n = min(fits)[1]
        else:
            n = len(bins)
            bins.append((capacity, frozenset(), frozenset()))
        left, s, c = bins[n]
        bins[n] = (left - sizes[k], s | {sources[k]}, c | {copies[k]})
        where[k] = n
    return where


@pytest.mark.parametrize("seed", range(6))
def test_equals_plain_best_fit(seed, monkeypatch):
    monkeypatch.setattr(packing._Blocks, "LENGTH", 8)
    rng = random.Random(seed)
    n = 400
    sizes = [rng.choice([0, 1, rng.randint(1, 100), 100]) for _ in range(n)]
    sources = [None if rng.random() < 0.1 else ("hot" if rng.random() < 0.33 else rng.randrange(12)) for _ in range(n)]
    copies = [None if rng.random() < 0.1 else rng.randrange(60) for _ in range(n)]
    assert packing.pack(sizes, sources, copies, 100) == plain_best_fit(sizes, sources, copies, 100)


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], SCHEMA)


def test_bins_hold_their_limits(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(["w"] * rng.randint(1, 70) + [f"d{k % 90}"]), rng.choice(["a", "b", None, "c"])) for k in range(300)]
    rows += [(None, None, "a"), (500, "", None), (501, " \n", "b"), (1, rows[1][1], rows[1][2]), (502, "x " * 205, "z"), (503, "q " * 100, "z")]
    result = packing.best_fit(table(spark, rows), capacity=50, shard=80)
    assert result.columns == ["doc_id", "piece", "start", "n_tokens", "shard", "bin"]
    found = result.collect()
    by_bin, by_doc = defaultdict(int), defaultdict(list)
    for r in found:
        by_bin[r.shard, r.bin] += r.n_tokens
        by_doc[r.doc_id].append((r.piece, r.start, r.n_tokens))
    assert max(by_bin.values()) <= 50
    assert sorted(by_doc[502]) == [(k, 50 * k, 50) for k in range(4)] + [(4, 200, 5)]
    assert sorted(by_doc[503]) == [(0, 0, 50), (1, 50, 50)]
    assert by_doc[None] == by_doc[500] == by_doc[501] == [(0, 0, 0)]
    assert sum(by_bin.values()) == sum(len((t or "").split()) for _, t, _ in rows)
    told = {i: (s, (t or "").lower()) for i, t, s in rows}
    for place in by_bin:
        inside = [told[r.doc_id] for r in found if (r.shard, r.bin) == place]
        sources = [s for s, _ in inside if s is not None]
        assert len(sources) == len(set(sources)) and len(inside) == len({t for _, t in inside})
    again = packing.best_fit(table(spark, rows[::-1]), capacity=50, shard=80)
    assert sorted(map(str, again.collect())) == sorted(map(str, found))


def test_near_copies_lie_apart_and_repeated_rows_are_dealt(spark):
    words = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join([*words[:59], f"x{k}"]), f"s{k}") for k in range(10)] + [(50, "other words " * 5, "t")] * 40
    found = packing.best_fit(table(spark, rows), shard=10, near_copies=True).collect()
    near = [(r.shard, r.bin) for r in found if r.doc_id < 10]
    assert len(near) == len(set(near)) == 10 and len(found) == 50
    assert {sum(r.shard == s for r in found if r.doc_id == 50) for s in range(5)} == {8}


def test_empty_table_and_wrong_capacity(spark):
    assert packing.best_fit(table(spark, [])).collect() == []
    with pytest.raises(ValueError):
        packing.best_fit(table(spark, []), capacity=0)
