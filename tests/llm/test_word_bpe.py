from __future__ import annotations

import random
import unicodedata

import numpy as np
import pytest
from tokenizers import Tokenizer

from larderflow.llm import word_bpe
from larderflow.llm.queries import WORD_BPE

ODD = [
    "", " ", "\n\t ", "I'll we've THEY'RE it's don't I'M 'tis 'S", "x<|endoftext|>Y <|startoftext|><|ENDOFTEXT|>", "ΟΔΟΣ ΣΑΣ", "İstanbul ǅ ﬁ ẞ",
    "é É́ 가 ½ ² ٣ 12345", "😂" * 40, "日本語テキスト", "a​b­c﻿", "__init__ --- ...!!! #$%", "\u0000\u0001 \x85  x", "'" * 9, "'ll" * 5,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD_BPE)


@pytest.fixture(scope="module")
def vocabulary():
    return word_bpe.Vocabulary(WORD_BPE)


def texts(seed, n):
    rng = random.Random(seed)
    pool = [t.replace("</w>", " ") for t in word_bpe.vocabulary(WORD_BPE).said]
    for k in range(n):
        yield [
            lambda: "".join(rng.choice(pool) for _ in range(rng.randint(1, 40))),
            lambda: "".join(rng.choice("abcdefgh THE in 12,.'s") for _ in range(rng.randint(0, 150))),
            lambda: "".join(chr(rng.choice([rng.randint(1, 0x24F), rng.randint(0x370, 0x52F), rng.randint(0x4E00, 0x9FFF)])) for _ in range(rng.randint(0, 60))),
            lambda: "".join(rng.choice("aabnanas") for _ in range(rng.randint(60, 400))),
        ][k % 4]()


def plain(vocabulary, word):
    """One word by scanning all pairs each time."""
    data = word.encode()
    parts = [*(int(vocabulary.inner[b]) for b in data[:-1]), int(vocabulary.last[data[-1]])]
    while True:
        ranks = [vocabulary.pairs.get(a << 32 | b, word_bpe.NONE) for a, b in zip(parts, parts[1:])]
        if not ranks or min(ranks) == word_bpe.NONE:
            return tuple(parts)
        k = ranks.index(min(ranks))
        parts[k : k + 2] = [int(vocabulary.merged[ranks[k]])]


def encoded(vocabulary, some):
    ids, ends = vocabulary.encode(some)
    return [ids[a:b].tolist() for a, b in zip(ends, ends[1:])]


def test_ids_equal_the_library(vocabulary, library, monkeypatch):
    monkeypatch.setattr(word_bpe, "KNOWN_WORDS", 500)
    some = [*ODD, *texts(1, 800)]
    for start in range(0, len(some), 90):
        part = some[start : start + 90]
        assert encoded(vocabulary, part) == [x.ids for x in library.encode_batch(part, add_special_tokens=False)]


def test_rank_arrays_and_heap_equal_plain_merging(vocabulary):
    rng = random.Random(5)
    words = ["".join(rng.choice("theranionsédg") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    side = vocabulary.merge_side_by_side([w.encode() for w in words])
    assert side == [plain(vocabulary, w) for w in words] == [vocabulary.merge_long(w.encode()) for w in words]


def test_every_assigned_sign(vocabulary, library):
    signs = [chr(c) for c in range(0x30000) if unicodedata.category(chr(c)) not in ("Cs", "Cn")]
    for start in range(0, len(signs), 20_000):
        part = [f"A{c}b {c}" for c in signs[start : start + 20_000]]
        assert encoded(vocabulary, part) == [x.ids for x in library.encode_batch(part, add_special_tokens=False)]


def test_rows_of_all_kinds(spark, library):
    rows = [(k, t) for k, t in enumerate([*ODD, *texts(3, 20)])]
    rows += [(100, None), (None, "one text"), (101, "same"), (101, "same"), (102, "a" * 30_000), (103, "word " * 20_000)]
    docs = spark.createDataFrame([(i, t, "mine", "other") for i, t in rows], "doc_id long, text string, ids string, decoded string")
    found = word_bpe.decode(word_bpe.encode(docs, WORD_BPE), WORD_BPE)
    assert found.columns == ["doc_id", "text", "ids", "decoded"]
    for row in (got := found.collect()):
        ids = library.encode(row.text or "", add_special_tokens=False).ids
        assert row.ids == ids
        assert row.decoded == library.decode(ids, skip_special_tokens=False)
    assert len(got) == len(rows)
    assert word_bpe.encode(docs.limit(0), WORD_BPE).collect() == []


def test_decoding_odd_ids(spark):
    said = word_bpe.vocabulary(WORD_BPE).said
    rows = [(1, None), (2, []), (3, [5, None, -1, 10**6, 49407]), (4, [320])]
    found = {r.k: r.decoded for r in word_bpe.decode(spark.createDataFrame(rows, "k int, ids array<int>"), WORD_BPE).collect()}
    assert found == {1: "", 2: "", 3: f"{said[5]} <|endoftext|>", 4: said[320]}


def test_short_pieces_of_work_give_the_same(spark, monkeypatch):
    """Texts encoded one by one have the ids of texts encoded in slices."""
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts(9, 60))], "doc_id long, text string")
    whole = {r.doc_id: r.ids for r in word_bpe.encode(docs, WORD_BPE).collect()}
    monkeypatch.setattr(word_bpe, "SLICE", 7)
    vocabulary = word_bpe.Vocabulary(WORD_BPE)
    assert list(word_bpe._slices(np.array([3, 9, 0, 2, 2, 5]))) == [(0, 1), (1, 2), (2, 5), (5, 6)]
    assert {r.doc_id: encoded(vocabulary, [r.text])[0] for r in docs.collect()} == whole
