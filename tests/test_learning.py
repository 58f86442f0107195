"""Boosted trees, importance, attributions, model files."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from larderflow.operators import boosting, explain
from larderflow.plans import lifecycle
from larderflow.session import fresh_path
from larderflow.settings import BoostingSettings, Settings
from larderflow.sources import models
from larderflow.sources.files import read_history

SETTINGS = BoostingSettings(n_estimators=4, max_depth=3, subsample=1.0, colsample=1.0)
FEATURES = ["x1", "x2", "noise"]


@pytest.fixture(scope="module")
def rows(spark):
    r = spark.range(600).withColumn("item_id", F.concat(F.lit("i"), F.col("id").cast("string")))
    r = r.withColumn("x1", (F.col("id") % 7).cast("double")).withColumn("x2", (F.col("id") % 5).cast("double"))
    r = r.withColumn("noise", (F.xxhash64("id") % 10).cast("double"))
    return r.withColumn("sales", 3 * F.col("x1") - F.col("x2") + 0.0)


@pytest.fixture(scope="module")
def model(rows):
    return boosting.fit(rows, FEATURES, settings=SETTINGS)


def test_predictions_are_never_negative_and_keep_every_row(rows, model, spark):
    incomplete = rows.withColumn("x1", F.when(F.col("id") % 10 != 0, F.col("x1")))
    out = boosting.predict(model, incomplete)
    assert out.count() == 600
    assert out.where("y_pred < 0").isEmpty()
    assert out.where("y_pred is null").isEmpty()


def plain_split(rows, names, reg_lambda=1.0):
    """The best first split by trying every value of every feature, missing rows on either side."""
    g = [r["p"] - r["sales"] for r in rows]
    score = lambda some: sum(g[k] for k in some) ** 2 / (len(some) + reg_lambda)
    best = None
    for name in names:
        values = sorted({r[name] for r in rows if r[name] is not None})
        for limit in values:
            for missing_left in (True, False):
                left = [k for k, r in enumerate(rows) if (missing_left if r[name] is None else r[name] <= limit)]
                right = sorted(set(range(len(rows))) - set(left))
                if left and right:
                    gain = score(left) + score(right) - score(range(len(rows)))
                    if best is None or gain > best[0] + 1e-9:
                        best = (gain, name, limit, missing_left, left, right)
    return best


def test_first_tree_equals_trying_every_split(spark):
    """Depth 2, missing values in all features, once over all tasks and once in one task."""
    table = [(k, None if k % 3 == 0 else float(k % 11), None if k % 4 == 1 else float(k * 7 % 13), float(k % 5), (k * k % 17) * 1.0) for k in range(120)]
    df = spark.createDataFrame(table, "id string, a double, b double, c double, sales double".replace("id string", "id long")).repartition(4)
    for local_rows in (1, 1000):
        settings = BoostingSettings(n_estimators=1, max_depth=2, subsample=1.0, colsample=1.0, learning_rate=1.0, local_rows=local_rows)
        model = boosting.fit(df, ["a", "b", "c"], settings=settings)
        rows = [r.asDict() | {"p": model.base} for r in df.collect()]
        tree = model.trees[0]

        def check(node, some, levels):
            found = plain_split(some, ["a", "b", "c"])
            if not levels:
                assert tree.value[node] == pytest.approx(-sum(r["p"] - r["sales"] for r in some) / (len(some) + 1), abs=1e-6)
                return
            assert tree.gain[node] == pytest.approx(found[0], abs=1e-4)
            assert (model.features[tree.feature[node]], tree.missing_left[node]) == (found[1], found[3])
            check(tree.left[node], [some[k] for k in found[4]], levels - 1)
            check(tree.left[node] + 1, [some[k] for k in found[5]], levels - 1)

        check(0, rows, 2)


def test_trees_do_not_depend_on_partitions_or_on_who_grows_them(rows):
    noisy = rows.withColumn("sales", F.col("sales") + (F.xxhash64("id") % 7) / 3).withColumn("x2", F.when(F.col("id") % 6 != 0, F.col("x2")))
    settings = BoostingSettings(n_estimators=12, max_depth=4)
    one = boosting.fit(noisy.repartition(1), FEATURES, settings=settings)
    many = boosting.fit(noisy.repartition(7), FEATURES, settings=BoostingSettings(n_estimators=12, max_depth=4, local_rows=40))
    predictions = [{r.id: r.y_pred for r in boosting.predict(m, noisy).collect()} for m in (one, many)]
    assert predictions[0] == pytest.approx(predictions[1], abs=1e-6)
    again = boosting.fit(noisy.repartition(5), FEATURES, settings=settings)
    assert boosting.described(again) == boosting.described(one) and again.trees == one.trees


def test_missing_values_carry_meaning(spark):
    """Rows without a value sell 9, others 1: a model that dropped them would not know."""
    df = spark.range(300).selectExpr("id", "if(id % 4 = 0, null, double(id % 9)) x1", "double(id % 2) x2", "if(id % 4 = 0, 9.0D, 1.0D) sales")
    model = boosting.fit(df, ["x1", "x2"], settings=BoostingSettings(n_estimators=60, max_depth=2, subsample=1.0, colsample=1.0))
    out = boosting.predict(model, df)
    assert out.where("abs(y_pred - sales) > 0.1").isEmpty()
    assert boosting.feature_importance(model, spark).first().feature == "x1"


def test_rows_without_target_are_counted_and_empty_tables_predict_zero(rows, spark):
    some = rows.withColumn("sales", F.when(F.col("id") >= 10, F.col("sales")))
    model = boosting.fit(some, FEATURES, settings=SETTINGS)
    assert (model.n_rows, model.n_without_target) == (590, 10)
    assert boosting.predict(model, some).where("y_pred is null").isEmpty()
    empty = boosting.fit(rows.limit(0), FEATURES, settings=SETTINGS)
    assert {r.y_pred for r in boosting.predict(empty, rows.limit(3)).collect()} == {0.0}


def test_many_values_are_binned_by_quantiles(spark):
    df = spark.range(5000).selectExpr("double(id) x", "double(id % 3) y", "cast(null as double) none")
    edges = boosting.bin_edges(df, ["x", "y", "none"])
    assert edges["y"] == [0.0, 1.0] and edges["none"] == []
    assert len(edges["x"]) == 254 and max(b - a for a, b in zip(edges["x"], edges["x"][1:])) < 25


def test_importance_sums_to_one_and_is_ranked(model, spark):
    found = boosting.feature_importance(model, spark).collect()
    assert sum(r.importance for r in found) == pytest.approx(1.0)
    assert found[0].feature == "x1"
    assert len(boosting.feature_importance(model, spark, 1).collect()) == 1


def test_missing_model(rows, spark):
    for call in (
        lambda: boosting.predict(None, rows),
        lambda: boosting.feature_importance(None, spark),
        lambda: models.save_model(None, "x", spark),
    ):
        with pytest.raises(boosting.NotFitted):
            call()


def test_numeric_features_leave_out_target_and_identifiers(rows):
    assert boosting.numeric_features(rows.withColumn("id", F.col("id"))) == FEATURES


def test_validation_stops_early(rows):
    noise = rows.withColumn("sales", (F.xxhash64(F.lit(1), "id") % 50).cast("double"))
    settings = BoostingSettings(n_estimators=20, max_depth=4, subsample=1.0, colsample=1.0)
    held_out = noise.where("id % 3 = 0")
    stopped = boosting.fit(noise.where("id % 3 <> 0"), FEATURES, settings=settings, validation=held_out)
    assert boosting.tree_count(stopped) < 20


def test_rows_are_stored_in_blocks_and_validated_once_for_ten_trees(rows, monkeypatch):
    """A pass takes few large cells, and 12 trees need two passes for their validation errors."""
    stored, passes, written, errors = [], [], boosting.written, boosting._errors
    monkeypatch.setattr(boosting, "written", lambda df, label: stored.append(written(df, label)) or stored[-1])
    monkeypatch.setattr(boosting, "_errors", lambda *given: passes.append(errors(*given)) or passes[-1])
    noise = rows.withColumn("sales", F.col("sales") + F.xxhash64("id") % 5).repartition(2)
    counted = []
    monkeypatch.setattr(boosting, "discard", lambda table: counted.append(table.count()))
    model = boosting.fit(noise, FEATURES, settings=BoostingSettings(n_estimators=12, max_depth=3), validation=noise.where("id % 4 = 0"), stop=False)
    assert len(counted) == len(stored) == 2 and max(counted) <= 8
    assert [len(e) for e in passes] == [10, 2] and list(model.errors) == passes[0] + passes[1]
    for n in (1, 11, 12):
        some = boosting.replace(model, trees=model.trees[:n])
        apart = noise.where("id % 4 = 0").select(F.sqrt(F.avg(F.pow(boosting.raw_prediction(some) - F.col("sales"), 2)))).first()[0]
        assert model.errors[n - 1] == pytest.approx(apart)


def test_stopping_gives_the_model_of_all_trees_cut(rows):
    """Errors are looked at every ten trees; trees beyond the stop leave nothing behind."""
    noise = rows.withColumn("sales", (F.xxhash64(F.lit(1), "id") % 50).cast("double"))
    train, held_out = noise.where("id % 3 <> 0"), noise.where("id % 3 = 0")
    settings = BoostingSettings(n_estimators=16, max_depth=4, patience=3)
    stopped = boosting.fit(train, FEATURES, settings=settings, validation=held_out)
    whole = boosting.fit(train, FEATURES, settings=settings, validation=held_out, stop=False)
    assert len(stopped.errors) == boosting.best_count(whole.errors, settings) + settings.patience < 16
    assert stopped.trees == boosting.stopped_early(whole, settings).trees and stopped.errors == pytest.approx(whole.errors[: len(stopped.errors)])


def test_attributions_add_up_to_the_prediction(rows, model):
    background = explain.background_sample(rows, FEATURES, n=15)
    found = explain.attributions(model, rows.where("id < 40"), ["id"], background, n_orders=6)
    sums = found.groupBy("id").agg(
        F.sum("attribution").alias("total"), F.first("base_value").alias("base"), F.first("prediction").alias("prediction")
    )
    joined = sums.join(rows.select("id", boosting.raw_prediction(model).alias("direct")), "id")
    assert joined.count() == 40
    assert joined.where(F.abs(F.col("base") + F.col("total") - F.col("direct")) > 1e-9).isEmpty()
    assert explain.global_importance(found, 2).first().feature == "x1"
    one = explain.explain_row(found, id=3).collect()
    assert len(one) == 3 and abs(one[0].attribution) >= abs(one[-1].attribution)


def test_all_orders_give_exact_shapley_values(rows, spark):
    """For a linear function the exact value is weight x (x - mean background)."""
    background = explain.background_sample(rows, FEATURES, n=10)
    means = background.agg(*[F.avg(c).alias(c) for c in FEATURES]).first()

    class Linear:
        features = FEATURES

    predict = lambda df: df.withColumn("prediction", 2 * F.col("x1") + F.col("x2") * F.col("x2"))
    found = explain.attributions(Linear(), rows.where("id < 5"), ["id"], background, n_orders=6, predict=predict)
    for r in found.where("feature = 'x1'").collect():
        assert r.attribution == pytest.approx(2 * (r.feature_value - means["x1"]))
    assert all(r.attribution == 0 for r in found.where("feature = 'noise'").collect())


def test_tree_attributions_equal_all_orders(rows, spark):
    """Exact values against all six orders of three features, with missing values on both sides."""
    some = rows.withColumn("x1", F.when(F.col("id") % 5 != 0, F.col("x1"))).withColumn("noise", F.when(F.col("id") % 3 != 0, F.col("noise")))
    model = boosting.fit(some, FEATURES, settings=BoostingSettings(n_estimators=6, max_depth=4, subsample=0.7, colsample=1.0))
    background = explain.background_sample(some, FEATURES, n=12)
    key = lambda r: (r.id, r.feature)
    few = some.where("id < 30")
    exact = sorted(explain.tree_attributions(model, few, ["id"], background).collect(), key=key)
    sampled = sorted(explain.attributions(model, few, ["id"], background, n_orders=6).collect(), key=key)
    assert [key(r) for r in exact] == [key(r) for r in sampled]
    for a, b in zip(exact, sampled, strict=True):
        assert (a.attribution, a.base_value, a.prediction) == pytest.approx((b.attribution, b.base_value, b.prediction), abs=1e-9)
        assert a.feature_value == b.feature_value


def test_background_rows_that_follow_a_path_alike_count_once(rows, model):
    """Forty copies of three rows make the patterns of three rows, and the same values."""
    three = rows.where("id < 3")
    copies = three.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(40))))
    names = model.features
    values = [[float(r[c]) for c in names] for r in three.collect()]
    paths = explain._Paths(model)
    few, many = (paths.patterns(paths.followed(np.array(v))) for v in (values, values * 40))
    assert [list(x) for x in few[:2]] == [list(x) for x in many[:2]] and list(few[2] * 40) == list(many[2])
    found = [
        {(r.id, r.feature): r.attribution for r in explain.tree_attributions(model, rows.where("id between 20 and 30"), ["id"], b).collect()}
        for b in (three, copies)
    ]
    assert found[0] == pytest.approx(found[1])


def test_tree_attributions_of_a_model_without_splits(rows):
    flat = boosting.fit(rows.withColumn("sales", F.lit(2.0)), FEATURES, settings=SETTINGS)
    found = explain.tree_attributions(flat, rows.limit(2), ["id"], explain.background_sample(rows, FEATURES, n=3)).collect()
    assert len(found) == 6 and all(r.attribution == 0 and r.prediction == r.base_value == 2 for r in found)


def test_background_sample_is_repeatable(rows):
    a, b = (explain.background_sample(df, FEATURES, 10).collect() for df in (rows, rows.repartition(5)))
    assert sorted(a) == sorted(b) and len(a) == 10


def test_saved_model_predicts_the_same(rows, model, spark):
    path = fresh_path(spark, "model")
    models.save_model(model, path, spark)
    loaded = models.load_model(path, spark)
    assert loaded == model
    assert boosting.feature_names(loaded) == FEATURES
    a = boosting.predict(model, rows).orderBy("id").collect()
    assert a == boosting.predict(loaded, rows).orderBy("id").collect()


def test_model_card(model, spark):
    card = models.model_card(spark, model, "trees", "1.2.0", "GBT", 7, {"WMAPE": 12.5}, F.lit("2016-01-01").cast("date")).first()
    assert (card.model_name, card.features_count, card.forecast_horizon) == ("trees", 3, 7)
    assert card.performance_metrics == {"WMAPE": 12.5}


def test_from_fit_to_decision(spark):
    df = spark.range(900).selectExpr(
        "'s' store_id", "cast(id % 3 as string) item_id", "date_add(date'2020-01-01', cast(id div 3 as int)) date", "double(id div 3 % 7) dow",
        "double(id div 3 % 7 * 2 + id % 3) sales", "if(id < 600, 'train', if(id < 750, 'val', 'test')) split",
    ).selectExpr("*", "sales + 1 lag_1", "sales + 4 lag_7", "sales + 2 rolling_mean_7", "if(split = 'test', 9.0D, 1.0D) moved")
    settings = Settings(boosting=BoostingSettings(n_estimators=40, max_depth=4))
    model = lifecycle.fit_by_split(df, ["dow", "lag_1", "moved"], settings)
    history, day = fresh_path(spark, "judged"), lambda x: F.lit(x).cast("date")
    production = spark.createDataFrame([(50.0,)], "WMAPE double")
    for _ in range(2):  # the second run of the same number replaces the first
        told = lifecycle.judge(model, df, history, 1, day("2020-11-01"), day("2020-10-20"), production, settings)
    assert read_history(spark, history).count() == 1
    assert told.comparison.first().model == "boosted_trees"
    assert {r.column for r in told.drift.where("has_drift").collect()} == {"moved"}
    assert told.retrain.first().reasons == ["drift"] and told.promotion.first().promote
    scores = {r.model: r.WMAPE for r in told.scores.collect()}
    assert scores["boosted_trees"] < scores["naive"] < scores["moving_avg_7"] < scores["seasonal_naive"]
    flat = boosting.BoostedTrees(model.features, 0.0, [])
    later = lifecycle.judge(flat, df, history, 2, day("2020-12-01"), day("2020-10-20"), production, settings)
    assert later.retrain.first().reasons == ["performance", "drift", "age"] and not later.promotion.first().promote
