from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest

from larderflow.llm import quality, toxicity

DIR = "/root/testdata/sf0.1"
SCHEMA = "doc_id long, text string, features string, votes int, score int, label string"


def fold(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds


def area(score, truth):
    """Chance that a text of label 1 scores above one of label 0."""
    order = np.argsort(np.argsort(score)) + 1
    ones = truth == 1
    return (order[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())


@pytest.mark.parametrize(("module", "label", "least", "recall"), [(quality, "quality", 0.97, 0.98), (toxicity, "toxic", 0.9, 0.8)])
def test_held_out_accuracy(spark, module, label, least, recall):
    docs, labels = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "labels"))
    rows = module.score(docs, labels).join(labels, "doc_id").toPandas()
    assert (rows.held_out == [fold(i, module.FOLDS) == module.HELD_OUT for i in rows.doc_id]).all()
    held = rows[rows.held_out]
    assert area(held.score.values, held[label].values) >= least
    assert held.predicted[held[label] == 1].mean() >= recall and held.predicted[held[label] == 0].mean() <= 0.1
    assert ((rows.score >= 0.3) == (rows.predicted == 1)).all() and rows.score.between(0, 1).all()


@pytest.mark.parametrize(("module", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_held_out_labels_change_nothing(spark, module, label):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.toPandas()
    outside = np.array([fold(i, module.FOLDS) == module.HELD_OUT for i in flipped.doc_id])
    flipped.loc[outside, label] = 1 - flipped.loc[outside, label]
    a, b = (sorted((r.doc_id, r.score) for r in module.score(docs, t).collect()) for t in (labels, spark.createDataFrame(flipped)))
    assert a == b


@pytest.mark.parametrize(("module", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_odd_rows(spark, module, label):
    rows = [(1, "Some words here. And more!"), (2, None), (3, ""), (None, "x"), (4, "\n\n \n"), (1, "Some words here. And more!"), (5, "you idiot " * 40_000), (6, "é")]
    docs = spark.createDataFrame([(*r, "f", 1, 2, "l") for r in rows], SCHEMA)
    for marks in ([], [(1, 1), (2, 0), (3, None), (None, 1), (5, 1), (6, 0), (77, 1)], [(1, 1), (5, 1)]):
        labels = spark.createDataFrame([(i, v, "t") for i, v in marks], f"doc_id long, {label} int, text string")
        found = module.score(docs, labels).collect()
        assert sorted(str(r.doc_id) for r in found) == sorted(str(i) for i, _ in rows)
        by = {r.doc_id: r.score for r in found}
        assert by[2] == by[3] and all(0 <= r.score <= 1 for r in found)
        assert all(not r.held_out for r in found if r.doc_id is None)
        kept = module.accepted(docs, labels)
        assert kept.columns == docs.columns
        wanted = [str(r.doc_id) for r in found if (r.score >= 0.3) == (module is quality)]
        assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(wanted)
        assert module.score(docs.limit(0), labels).collect() == []


def test_features_by_plain_means():
    text = "AB cd 12.\nAB cd 12.\n\nx! é|"
    row = dict(zip(quality.FEATURES, quality.describe(pa.array([None, text, ""]))[1], strict=True))
    data, words = text.encode(), text.split()
    assert row["log_words"] == pytest.approx(np.log1p(len(words))) and row["log_bytes"] == pytest.approx(np.log1p(len(data)))
    assert row["distinct_words"] == pytest.approx(len(set(words)) / len(words))
    assert row["distinct_lines"] == pytest.approx(3 / 4) and row["upper"] == pytest.approx(4 / len(data))
    assert row["symbols"] == pytest.approx(1 / len(data)) and row["beyond_ascii"] == pytest.approx(1 / len(data))
    assert not quality.describe(pa.array([None, text, ""]))[[0, 2]].any()


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x[:3000], y[:3000])
    assert (0, 1) in [tuple(sorted(p)) for p in model.pairs]
    assert area(model.score(x[3000:]), y[3000:]) > 0.95


def test_label_model_finds_accuracies_and_correlations():
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.2
    fires = np.zeros((len(truth), len(toxicity.VOTERS)), int)
    for v in range(len(toxicity.VOTERS)):
        fires[:, v] = rng.random(len(truth)) < np.where(truth, 0.6, 0.05)
    fires[:, 3] = np.where(rng.random(len(truth)) < 0.9, fires[:, 2], fires[:, 3])  # mostly a copy of voter 2
    masks = (fires << np.arange(len(toxicity.VOTERS))).sum(1)
    patterns, counts = np.unique(masks, return_counts=True)
    model = toxicity.LabelModel(patterns, np.full(len(patterns), -1), counts.astype(float))
    assert model.prior == pytest.approx(0.2, abs=0.03)
    assert np.abs(model.fire[1] - 0.6).max() < 0.06 and np.abs(model.fire[0] - 0.05).max() < 0.03
    assert model.correlations[2, 3] > 0.6 and model.weights[2] < 0.7 < model.weights[0]
    assert ((model.posterior(masks, np.full(len(masks), -1)) > 0.5) == truth).mean() > 0.97


def test_toxicity_samples_labels_of_the_given_texts(spark, monkeypatch):
    """Labels of texts that are not there take no place in the sample."""
    class Seen(Exception):
        pass

    def seen(docs, sample, id, text):
        raise Seen(sorted(sample))

    monkeypatch.setattr(toxicity, "SAMPLE", 20)
    monkeypatch.setattr(toxicity, "_sample_terms", seen)
    docs = spark.range(990, 1000).selectExpr("id AS doc_id", "'a b c' AS text")
    labels = spark.range(1000).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS toxic")
    wanted = [r.doc_id for r in docs.filter(toxicity.fold("doc_id", toxicity.FOLDS) != toxicity.HELD_OUT).collect()]
    with pytest.raises(Seen) as told:
        toxicity.trained(docs, labels)
    assert told.value.args[0] == wanted and wanted
