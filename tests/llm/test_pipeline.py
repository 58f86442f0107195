from __future__ import annotations

from collections import defaultdict

import corpus_pipeline
from larderflow.llm import quality, toxicity
from larderflow.session import written
from tests.llm.test_ngram_join import brute_force
from tests.llm.test_packing import plain_best_fit


def test_stages_against_plain_python(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(10_001, None, "en", "s", 0), (None, docs.first().text, None, None, 5)], docs.schema)
    start = docs.unionAll(odd).unionAll(docs.limit(3))
    start.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "toxicity", "near_copies", "packing"]
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        kept.append(docs)
        docs = written(stage(spark, docs, str(tmp_path)), name)
        if name != "packing":
            assert docs.columns == kept[0].columns

    def rows(table):
        return sorted(((r.doc_id, r.text) for r in table.collect()), key=str)

    good = {(r.doc_id) for r in quality.score(kept[0], labels).collect() if r.predicted}
    assert rows(kept[1]) == [r for r in rows(kept[0]) if r[0] in good]
    bad = {(r.doc_id) for r in toxicity.score(kept[1], labels).collect() if r.predicted}
    assert rows(kept[2]) == [r for r in rows(kept[1]) if r[0] not in bad]
    before = rows(kept[2])
    classes = brute_force(before)
    firsts = {(c, i, t) for (i, n, c), (_, t) in zip(classes, before, strict=True) if n and i == c}
    assert rows(kept[3]) == sorted([(i, t) for _, i, t in firsts] + [r for r, (_, n, _) in zip(before, classes, strict=True) if not n], key=str)
    packed, by_bin, total = docs.collect(), defaultdict(int), defaultdict(int)
    for r in packed:
        by_bin[r.shard, r.bin] += r.n_tokens
        total[r.doc_id] += r.n_tokens
    assert total == {i: len((t or "").split()) for i, t in rows(kept[3])}
    assert max(by_bin.values()) <= 2048
    rest = sorted((r for r in packed if r.n_tokens < 2048), key=lambda r: -r.n_tokens)
    source = {r.doc_id: r.source for r in kept[3].collect()}
    bins = plain_best_fit([r.n_tokens for r in rest], [source[r.doc_id] for r in rest], [None] * len(rest), 2048)
    assert len(set(bins)) == len({(r.shard, r.bin) for r in rest})


def test_empty_tables_missing_labels_and_clashing_columns(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    more = docs.selectExpr("*", "1 score", "'x' label", "2 component", "3 bin", "'y' features", "4 sid")
    spark.read.parquet(f"{sf_dir}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    for some in (more, more.limit(0)):
        held = written(some, "some")
        n = held.count()
        for name, stage in corpus_pipeline.STAGES:
            held = written(stage(spark, held, str(tmp_path)), name)
            if name != "packing":
                assert held.columns == more.columns
            if name == "quality":
                assert held.count() == n
            assert held.isEmpty() == (n == 0)
