from __future__ import annotations

import random

import pytest
import sentencepiece

from larderflow.llm import sentencepiece_scan as scan
from larderflow.llm.queries import PIECES

SCHEMA = "doc_id long, text string, text_key string, ids string, chunk int"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def texts(seed, n):
    rng = random.Random(seed)
    pool = list(scan.pieces_of(PIECES).ids)
    for k in range(n):
        yield [
            lambda: "".join(rng.choice("abcdefgh th e in ") for _ in range(rng.randint(0, 120))),
            lambda: "".join(rng.choice(pool) for _ in range(rng.randint(1, 30))).replace(scan.MARK, " "),
            lambda: "".join(rng.choice(" \n aé①ÿ") for _ in range(rng.randint(0, 80))),
            lambda: "".join(rng.choice("internationalizationthe") for _ in range(rng.randint(30, 200))),
            lambda: " " * rng.randint(0, 60) + rng.choice(["", "x", "\n"]) + " " * rng.randint(0, 40),
        ][k % 5]()


def in_chunks(pieces, text, size):
    said, reach = scan.marked(text), pieces.longest
    chunks = [scan.Chunk(pieces, said[max(0, i - reach) : i], said[i : i + size], said[i + size : i + size + reach]) for i in range(0, len(said), size)]
    path = scan.states([c.transfer() for c in chunks]) if chunks else []
    return [k for c, (entry, leave) in zip(chunks, path, strict=True) for k in c.trace(entry, leave)]


def test_ids_equal_the_library_whole_and_in_chunks(library):
    pieces = scan.pieces_of(PIECES)
    for text in texts(1, 250):
        ids = library.encode(text)
        assert scan.encode_text(pieces, text) == ids
        for size in (5, 17, 64):
            assert in_chunks(pieces, text, size) == ids
        assert scan.decode_ids(pieces, ids).decode() == text


def test_many_texts_at_once_equal_the_library(library, monkeypatch):
    monkeypatch.setattr(scan, "KNOWN_WORDS", 300)
    pieces = scan.Pieces(PIECES)
    some = [*texts(7, 300), "", "a", " a", "a ", "a\nb", "a \n b", "\n", "\n\n", "a  b", "x▁y", "é①\n①é q", "z" * 60 + " y", "ab\n" * 40]
    for start in range(0, len(some), 50):
        part = some[start : start + 50]
        assert [list(ids) for ids in scan.encode_texts(pieces, part)] == library.encode(part)


def test_product_is_associative():
    rng = random.Random(2)

    def some():
        return {(d, "a"): [(e, "a") for e in range(4) if rng.random() < 0.5] for d in range(4)}

    for _ in range(50):
        a, b, c = some(), some(), some()
        left, right = scan.product(scan.product(a, b), c), scan.product(a, scan.product(b, c))
        assert {k: set(v) for k, v in left.items()} == {k: set(v) for k, v in right.items()}


def test_rows_of_all_kinds(spark, library):
    rows = [(k, t) for k, t in enumerate(texts(3, 15))] + [(50, None), (51, ""), (None, "one text"), (52, "a" * 3000), (52, "a" * 3000)]
    rows += [(None, "b c " * 700), (53, "x▁y"), (54, "word " * 2000)]
    docs = spark.createDataFrame([(*r, "k", "i", 0) for r in rows], SCHEMA)
    result = scan.round_trips(docs, PIECES, chunk=900)
    assert result.columns == ["doc_id", "n_tokens", "ids_hash", "round_trip"]
    found = sorted((str(r.doc_id), r.n_tokens, r.round_trip) for r in result.collect())
    assert found == sorted((str(i), len(library.encode(t or "")), i != 53) for i, t in rows)
    encoded = scan.encode(docs.filter("doc_id IN (54, 3)"), PIECES, chunk=900).collect()
    joined = {i: [k for r in sorted(encoded, key=lambda r: r.chunk) if r.doc_id == i for k in r.ids] for i in (54, 3)}
    assert joined == {54: library.encode("word " * 2000), 3: library.encode(rows[3][1])}
    assert scan.round_trips(docs.limit(0), PIECES).collect() == []
