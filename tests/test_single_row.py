"""The query of one attribution explains one row only."""

from __future__ import annotations

from larderflow.catalog import evaluation_queries as queries
from larderflow.operators import boosting, explain


def test_one_row_is_explained(spark, monkeypatch):
    explained, whole = [], explain.tree_attributions
    stump = boosting.Tree(depth=1)
    stump.add_leaf(0.0, 2)
    stump.split(0, 3, 1, 2.0, True, 1.0, [(-1.0, 1), (1.0, 1)])
    model = boosting.BoostedTrees(list(queries.BOOST_FEATURES), 5.0, [stump])
    monkeypatch.setattr(queries, "fitted", lambda *_: model)
    monkeypatch.setattr(explain, "tree_attributions", lambda m, rows, *rest: explained.append(rows.count()) or whole(m, rows, *rest))
    sf_dir = "/root/testdata/sf0.001"
    found = queries.single_row(spark, sf_dir).collect()
    assert explained == [1] and len(found) == len(queries.BOOST_FEATURES)
    first = queries.training(spark, sf_dir).where("split = 'test'").orderBy("store_id", "item_id", "date").first()
    assert {(r.store_id, r.item_id, r.date) for r in found} == {(first.store_id, first.item_id, first.date)}
    rest = whole(model, queries.training(spark, sf_dir).where("split = 'test'"), ["store_id", "item_id", "date"], queries._background(spark, sf_dir))
    assert found == explain.explain_row(rest, store_id=first.store_id, item_id=first.item_id, date=first.date).select(*found[0].__fields__).collect()
