from __future__ import annotations

import hashlib
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from larderflow.llm import merkle

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def raised(nodes):
    """All levels over some nodes."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][k : k + 8])) for k in range(0, len(levels[-1]), 8)])
    return levels


def path(levels, place):
    """(before, after) of each level."""
    for row in levels[:-1]:
        start = place - place % 8
        yield row[start:place], row[place + 1 : start + 8]
        place //= 8


def postorder(levels, level, place):
    if level:
        for child in range(place * 8, min(place * 8 + 8, len(levels[level - 1]))):
            yield from postorder(levels, level - 1, child)
    yield level, place


def leaf_of(row):
    return h("".join("-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in FIELDS))


def plain(rows):
    """(doc_id, leaf, siblings, subroot, root) of all rows."""
    told = sorted(rows, key=lambda r: ((r["lang"] is not None, (r["lang"] or "").encode()), (r["doc_id"] is not None, r["doc_id"] or 0), leaf_of(r)))
    trees = [(lang, list(some)) for lang, some in groupby(told, key=lambda r: r["lang"])]
    built = [raised([leaf_of(r) for r in some]) for _, some in trees]
    top = raised([levels[-1][0] for levels in built])
    for k, (_, some) in enumerate(trees):
        for place, row in enumerate(some):
            ways = [*path(built[k], place), *path(top, k)]
            yield row["doc_id"], leaf_of(row), "".join("".join(a + b) for a, b in ways), built[k][-1][0], top[-1][0]


@pytest.mark.parametrize("n", [1, 2, 8, 9, 63, 64, 65, 72, 511, 513, 600])
def test_positions_in_the_log(n):
    levels = raised([str(k) for k in range(n)])
    height = len(levels) - 1
    order = list(postorder(levels, height, 0))
    assert [merkle.log_position(level, place, n, height) for level, place in order] == list(range(len(order)))
    assert merkle.append_log(levels[0], height) == [(level, levels[level][place]) for level, place in order]
    assert merkle.level_sizes(n) == [len(row) for row in levels]


def table(spark, rows):
    schema = "doc_id long, source string, lang string, n_chars int, text string, leaf string, claimed string, tree string"
    return spark.createDataFrame([(*(r[f] for f in FIELDS), "a", "b", "c") for r in rows], schema)


def leaves(docs):
    return docs.select(F.col("lang").alias("group"), F.col("doc_id").alias("id"), merkle.leaf_digest(*FIELDS).alias("leaf"), F.lit("0" * 64).alias("claimed"))


def some_rows():
    def row(k, lang, text="t"):
        return {"doc_id": k, "source": None if k == 3 else "s", "lang": lang, "n_chars": k, "text": text}

    rows = [row(k, "en", f"text {k} é") for k in range(0, 2700, 2)]  # three segments of a tree, out of step with the ids
    rows += [row(5, "de", "")] + [row(7, "de", None)] * 3 + [row(9, "de", "x" * 200_000)]
    rows += [row(k, None) for k in (1, 2)] + [row(11, "")] + [{**row(12, "fr"), "doc_id": None}, row(12, "fr"), row(12, "fr", "other")]
    rows += [row(k, f"l{k}") for k in range(20, 27)]  # more than eight groups
    return rows


def test_proofs_equal_plain_trees(spark):
    rows = some_rows()
    shown = merkle.proofs(merkle.build(leaves(table(spark, rows)))).withColumn("back", merkle.folded("leaf")).withColumn("odd", merkle.folded("claimed"))
    found = shown.select("id", "leaf", F.decode("siblings", "UTF-8").alias("s"), "subroot", "root", "back", "odd", "claimed").collect()
    key = lambda x: tuple(map(str, x))
    assert sorted((tuple(r[:5]) for r in found), key=key) == sorted(plain(rows), key=key)
    assert all(r.back == r.root and r.odd != r.root and r.claimed == "0" * 64 for r in found)


def test_log_is_whole_and_in_order(spark):
    rows = some_rows()
    held = merkle.log(merkle.build(leaves(table(spark, rows)))).filter("tree = '=en'").orderBy("position").collect()
    levels = raised([leaf_of(r) for r in rows if r["lang"] == "en"])
    assert [r.position for r in held] == list(range(len(held)))
    assert [r.digest for r in held] == [levels[level][place] for level, place in postorder(levels, len(levels) - 1, 0)]


def test_single_and_no_rows(spark):
    one = [{"doc_id": 4, "source": "s", "lang": "en", "n_chars": 1, "text": "t"}]
    found = merkle.proofs(merkle.build(leaves(table(spark, one)))).collect()
    assert [(r.leaf, bytes(r.siblings), r.before, r.after, r.subroot, r.root) for r in found] == [(leaf_of(one[0]), b"", [], [], leaf_of(one[0]), leaf_of(one[0]))]
    assert merkle.proofs(merkle.build(leaves(table(spark, one).limit(0)))).collect() == []


def test_half_of_the_rows_equal_are_dealt_over_partitions(spark):
    rows = [{"doc_id": 1, "source": "s", "lang": "en", "n_chars": 1, "text": "t"}] * 1000
    nodes, most = merkle._ordered(leaves(table(spark, rows)).select(F.concat(F.lit("="), "group").alias("tree"), "id", "leaf", "claimed"))
    assert most == 1000
    assert sorted(r.place for r in nodes.collect()) == list(range(1000))


def test_tampering_is_found(spark):
    docs = table(spark, [{"doc_id": k, "source": "s", "lang": "en", "n_chars": 1, "text": "A" if k % 2 else "a"} for k in range(100)])
    later = merkle.leaf_digest("doc_id", "source", "lang", "n_chars", F.lower("text"))
    told = docs.select(F.col("lang").alias("group"), F.col("doc_id").alias("id"), merkle.leaf_digest(*FIELDS).alias("leaf"), later.alias("claimed"))
    shown = merkle.proofs(merkle.build(told))
    assert {r.id: r.good for r in shown.select("id", (merkle.folded("claimed") == F.col("root")).alias("good")).collect()} == {k: k % 2 == 0 for k in range(100)}
