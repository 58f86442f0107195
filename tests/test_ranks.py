"""Exact ranks, quantiles and codes against pandas and numpy, with a third of all rows in one key."""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
import pytest

from larderflow.operators import encoding, exploration, fill, pricing, ranks
from larderflow.session import fresh_path


@pytest.fixture(autouse=True)
def fine_cuts(monkeypatch):
    """Cut ranges often, so that small fixtures span many of them."""
    monkeypatch.setattr(ranks, "SAMPLE_STRIDE", 3)
    monkeypatch.setattr(ranks, "CUTS", 40)


def hot_items(n=6000) -> pd.DataFrame:
    rng = np.random.default_rng(3)
    item = np.where(rng.random(n) < 0.35, "hot", rng.integers(0, 30, n).astype(str))
    price = np.round(rng.gamma(2.0, 20.0, n), 1)
    return pd.DataFrame({"row": range(n), "item_id": item, "sell_price": np.where(rng.random(n) < 0.1, np.nan, price)})


@pytest.fixture(scope="module")
def prices(spark):
    pdf = hot_items()
    rows = pdf.astype(object).where(pdf.notna(), None).values.tolist()
    return pdf, spark.createDataFrame(rows, "row bigint, item_id string, sell_price double")


def test_price_rank(prices):
    pdf, df = prices
    found = pricing.with_price_rank(df).toPandas().sort_values("row", ignore_index=True)
    expected = pdf.groupby("item_id")["sell_price"].rank(pct=True)
    np.testing.assert_allclose(found["price_rank"], expected, rtol=1e-12)


def test_rank_ties(spark):
    df = spark.createDataFrame([(i, "x", p) for i, p in enumerate([1.0, 1.0, 2.0, None, 3.0])], "i int, item_id string, sell_price double")
    found = [r.price_rank for r in pricing.with_price_rank(df).orderBy("i").collect()]
    assert found == [0.375, 0.375, 0.75, None, 1.0]


@pytest.mark.parametrize("probs", [[0.5], [0.0, 0.1, 0.25, 0.9, 1.0]])
def test_quantiles_by_key(prices, probs):
    pdf, df = prices
    found = {r.item_id: r.quantiles for r in ranks.exact_quantiles(df, "sell_price", probs, ["item_id"]).collect()}
    for item, group in pdf.groupby("item_id")["sell_price"]:
        np.testing.assert_allclose(found[item], np.quantile(group.dropna(), probs), rtol=1e-12)


def test_global_quantiles(prices):
    pdf, df = prices
    found = ranks.exact_quantiles(df, "sell_price", [0.01, 0.5, 0.99]).first().quantiles
    np.testing.assert_allclose(found, np.quantile(pdf["sell_price"].dropna(), [0.01, 0.5, 0.99]), rtol=1e-12)


def test_quantiles_of_nothing(spark):
    empty = spark.createDataFrame([(None,)], "x double")
    assert ranks.exact_quantiles(empty, "x", [0.5]).first().quantiles == [None]


def test_item_median_fill(spark):
    rows = [("a", "s1", None), ("a", "s2", 2.0), ("a", "s2", 5.0), ("b", "s1", None)]
    df = spark.createDataFrame(rows, "item_id string, store_id string, sell_price double")
    found = {(r.item_id, r.store_id, r.sell_price) for r in fill.fill_item_median(df).collect()}
    assert found == {("a", "s1", 3.5), ("a", "s2", 2.0), ("a", "s2", 5.0), ("b", "s1", None)}


def test_codes(spark):
    df = spark.createDataFrame([(0, "b"), (1, None), (2, "a")], "i int, store_id string")
    found = [r.store_id_encoded for r in encoding.with_codes(df).orderBy("i").collect()]
    assert found == [1, -1, 0]


def test_large_vocabulary_and_unseen_values(spark):
    values = sorted({f"v{i * 7919 % 10007}" for i in range(3000)})
    df = spark.createDataFrame([(v,) for v in values], "item_id string")
    codes = encoding.fit_codes(df, ["item_id"])
    assert {r.value: r.code for r in codes.collect()} == {v: i for i, v in enumerate(values)}
    later = spark.createDataFrame([(values[5],), ("unseen",)], "item_id string")
    assert {r.item_id: r.item_id_encoded for r in encoding.with_codes(later, ["item_id"], codes).collect()} == {
        values[5]: 5,
        "unseen": -1,
    }


def test_describe_and_box(prices):
    pdf, df = prices
    x = pdf["sell_price"].dropna()
    row = exploration.describe(df, ["sell_price"]).first()
    expected = pdf["sell_price"].describe()
    np.testing.assert_allclose(
        [row["count"], row["mean"], row["std"], row["min"], row["p25"], row["p50"], row["p75"], row["max"]], expected, rtol=1e-9
    )
    q1, q3 = np.quantile(x, [0.25, 0.75])
    inside = x[(x >= q1 - 1.5 * (q3 - q1)) & (x <= q3 + 1.5 * (q3 - q1))]
    box = exploration.box_stats(df, "sell_price").first()
    assert (box.whisker_low, box.whisker_high) == (inside.min(), inside.max())
    assert box.n_outliers == len(x) - len(inside)


def test_histogram(prices, spark):
    pdf, df = prices
    counts, edges = np.histogram(pdf["sell_price"].dropna(), bins=50)
    rows = exploration.histogram(df, "sell_price").orderBy("bin").collect()
    assert sum(r.n for r in rows) == counts.sum()
    np.testing.assert_allclose([r.lower for r in rows], edges[:-1], rtol=1e-9)
    flat = exploration.histogram(spark.createDataFrame([(2.0,), (2.0,)], "sales double")).where("n > 0").collect()
    assert [(r.bin, r.n) for r in flat] == [(25, 2)]


def test_correlation_of_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0)], "a double, b double")
    found = {(r["row"], r["column"]): r["value"] for r in exploration.correlation(df, "a", "b").collect()}
    assert found[("a", "b")] is None and found[("a", "a")] == pytest.approx(1.0)


def test_ranking_never_uses_one_task_for_the_facts(prices):
    _, df = prices
    plan = pricing.with_price_rank(df)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_sketched_quantiles_keep_their_rank_error(spark):
    df = spark.range(60_000).selectExpr(
        "id % 7 day", "double(pow(id * 7919 % 60000, 2)) a", "if(id % 3 = 0, double('nan'), if(id % 3 = 1, null, double(id % 50))) b", "cast(null as double) c"
    )
    names, probs, error = ["a", "b", "c"], [0.01, 0.25, 0.5, 0.9], 0.005
    whole = {r.column: r.quantiles for r in ranks.sketched_quantiles(ranks.sketches(df, names, error), names, probs).collect()}
    by_day = ranks.sketches(df.where("day <> 3"), names, error, ["day"]).unionByName(ranks.sketches(df.where("day = 3"), names, error, ["day"]))
    merged = {r.column: r.quantiles for r in ranks.sketched_quantiles(ranks.merge_sketches(by_day, names), names, probs).collect()}
    assert whole["c"] is None and merged["c"] is None
    for name in ("a", "b"):
        values = sorted(r[name] for r in df.where(f"{name} is not null and not isnan({name})").select(name).collect())
        for found in (whole[name], merged[name]):
            for p, value in zip(probs, found, strict=True):
                assert bisect.bisect_left(values, value) / len(values) - error <= p <= bisect.bisect_right(values, value) / len(values) + error
    assert len(ranks.column_quantiles(df, names, [0.5], rank_error=0.01).collect()) == 2
    plan = ranks.column_quantiles(df, ["a", "b"], [0.5], rank_error=0.01)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "Join" not in plan


def test_sketch_sizes():
    assert ranks.sketch_size(0.0133) in range(198, 203) and ranks.sketch_size(0.9) == 8
    for wrong in (0, 1, 1e-6):
        with pytest.raises(ValueError):
            ranks.sketch_size(wrong)


def test_codes_stay_when_values_come_later(spark):
    path = fresh_path(spark, "codes")
    frame = lambda *values: spark.createDataFrame([(v, "x" if v else None) for v in values], "item_id string, store_id string")
    told = lambda codes: {(r.column, r.value): (r.code, r.version) for r in codes.collect()}
    first = told(encoding.update_codes(frame("m", "c", None, "c"), path))
    assert first == {("item_id", "c"): (0, 0), ("item_id", "m"): (1, 0), ("store_id", "x"): (0, 0)}
    later = told(encoding.update_codes(frame("a", "z", "c", "b"), path))
    assert later == first | {("item_id", "a"): (2, 1), ("item_id", "b"): (3, 1), ("item_id", "z"): (4, 1)}
    assert told(encoding.update_codes(frame("a", "z"), path)) == later
    assert told(encoding.read_codes(spark, path, version=0)) == first
    encoded = encoding.with_codes(frame("c", "z", "new", None), codes=encoding.read_codes(spark, path))
    assert {r.item_id: r.item_id_encoded for r in encoded.collect()} == {"c": 0, "z": 4, "new": -1, None: -1}


def test_price_position_equals_mean_and_rank_with_one_lookup_of_facts(spark):
    df = spark.range(3000).selectExpr(
        "id", "if(id % 3 = 0, 'hot', concat('i', id % 40)) item_id", "if(id % 7 = 0, null, round(id * 31 % 101 / 4, 2)) sell_price", "'x' note"
    )
    found = {r.id: r for r in pricing.with_price_position(df).collect()}
    want = {r.id: r for r in pricing.with_price_rank(pricing.with_relative_price(df)).collect()}
    assert found.keys() == want.keys()
    for key, row in want.items():
        assert found[key].price_rank == row.price_rank and found[key].note == "x"
        assert found[key].price_relative == (None if row.price_relative is None else pytest.approx(row.price_relative, rel=1e-12))
    # Only one side of one join carries the other columns of the facts.
    plan = pricing.with_price_position(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(" AS note") == 1
