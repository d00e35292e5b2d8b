"""The FP-Growth fit in bounded pieces gives the itemsets of the whole."""

import pytest

from vitrine.plans import rules


def test_fit_in_pieces_equals_the_fit_in_one(spark, monkeypatch):
    rows = [([["a"], ["b", "a"], ["c", "b", "a"], ["d", "c"]][i % 4],) for i in range(400)]
    df = spark.createDataFrame(rows, "items array<string>").coalesce(1)
    told = lambda: sorted((tuple(r["items"]), r.freq) for r in rules.frequent_itemsets(df, 0.2).collect())
    whole = told()
    monkeypatch.setattr(rules, "FIT_ROWS", 10)
    pieces = []
    from pyspark.ml.fpm import FPGrowth
    fit = FPGrowth.fit
    monkeypatch.setattr(FPGrowth, "fit", lambda self, data, *a: pieces.append(data.rdd.getNumPartitions()) or fit(self, data, *a))
    assert told() == whole and len(whole) == 9 and pieces == [40]


def _told(df):
    return sorted((tuple(r["items"]), r.freq, r.support) for r in df.collect())


def test_counted_baskets_give_the_itemsets_of_the_fit(spark, monkeypatch):
    kinds = [[f"a:{i % 3}", f"b:{i % 5}", f"c:{i * i % 7}"] + ["d:yes"] * (i % 2) + [f"rare:{i}"] for i in range(300)]
    df = spark.createDataFrame([(k,) for k in kinds], "items array<string>").repartition(3)
    for support in (0.01, 0.05, 0.2, 1 / 3):
        assert _told(rules.frequent_itemsets(df, support, max_items=5)) == _told(rules.fitted_itemsets(df, support))
    monkeypatch.setattr(rules, "fitted_itemsets", lambda *a: pytest.fail("fitted"))
    assert len(_told(rules.frequent_itemsets(df, 0.2, max_items=5))) == 12
    assert _told(rules.frequent_itemsets(df.limit(0), 0.2, max_items=5)) == []


def test_many_distinct_baskets_are_fitted(spark, monkeypatch):
    df = spark.createDataFrame([([["a", "b"], ["c", "b"]][i % 2],) for i in range(4)], "items array<string>")
    monkeypatch.setattr(rules, "FEW_SUBSETS", 3)
    monkeypatch.setattr(rules, "SUBSETS_PER_ROW", 1)
    assert rules.counted_itemsets(df, 0.1, 7) is None
    assert _told(rules.frequent_itemsets(df, 0.5, max_items=7)) == _told(rules.fitted_itemsets(df, 0.5))
    with pytest.raises(ValueError, match="more than 1"):
        rules.frequent_itemsets(df, 0.1, max_items=1)
