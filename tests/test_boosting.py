"""Boosted trees: the trees of Spark ML where nothing is drawn, whatever the partitions, and a job a level."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from vitrine.operators import boosting as B

PARAMS = dict(maxIter=6, maxDepth=3, stepSize=0.1, seed=42)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = np.stack([rng.integers(0, 20, 900), rng.integers(0, 9, 900), rng.integers(0, 2, 900), np.full(900, 4)], axis=1).astype(float)
    y = x[:, 0] * 1.5 - (x[:, 1] > 4) * 7 + rng.normal(0, 2, 900)
    made = [(f"k{i}", x[i].tolist(), float(y[i]), int(y[i] > 12), float(1 + i % 3)) for i in range(900)]
    return spark.createDataFrame(made, "key string, x array<double>, y double, label int, w double").cache()


def _fit(df, classify, **params):
    return B.boosted_trees(df, "x", "label" if classify else "y", ["key"], classify, "w" if classify else None, **{**PARAMS, **params})


def _told(model):
    return [(t.feature.tolist(), t.split.tolist(), t.value.tolist(), t.weight) for t in model.trees]


def test_regression_equals_spark_ml(rows):
    from pyspark.ml.regression import GBTRegressor

    theirs = GBTRegressor(featuresCol="v", labelCol="y", **PARAMS).fit(rows.withColumn("v", array_to_vector("x")))
    both = theirs.transform(rows.withColumn("v", array_to_vector("x"))).withColumn("own", _fit(rows, False).margin(F.col("x")))
    assert all(abs(r.own - r.prediction) < 1e-4 for r in both.collect())


def test_classification_and_importances_equal_spark_ml(rows):
    from pyspark.ml.classification import GBTClassifier

    vectors = rows.withColumn("v", array_to_vector("x"))
    theirs = GBTClassifier(featuresCol="v", labelCol="label", weightCol="w", **PARAMS).fit(vectors)
    own = _fit(rows, True)
    both = theirs.transform(vectors).select(vector_to_array("probability")[1].alias("p"), own.probability(F.col("x")).alias("own"))
    assert all(abs(r.own - r.p) < 1e-4 for r in both.collect())
    assert np.abs(own.importances - theirs.featureImportances.toArray()).max() < 1e-3 and own.importances[3] == 0


def test_neither_partitions_nor_snapshots_change_the_trees(rows, monkeypatch):
    draws = dict(subsamplingRate=0.8, featureSubsetStrategy="0.8")
    told = _told(_fit(rows, True, **draws))
    assert _told(_fit(rows.repartition(7).orderBy(F.rand(5)), True, **draws)) == told
    assert _told(_fit(rows, True, **draws, maxIter=2)) == told[:2] != _told(_fit(rows, True, maxIter=2))
    monkeypatch.setattr(B, "SNAPSHOT", 2)
    monkeypatch.setattr(B, "BLOCK", 50)
    assert _told(_fit(rows, True, **draws)) == told


def test_a_level_is_one_job(spark, rows):
    def jobs(n):
        sc = spark.sparkContext
        sc.setJobGroup(f"trees-{n}", "")
        _fit(rows, False, maxIter=n)
        sc.setLocalProperty("spark.jobGroup.id", None)
        return len(sc.statusTracker().getJobIdsForGroup(f"trees-{n}"))

    assert 0 < jobs(8) - jobs(2) <= 6 * PARAMS["maxDepth"]


def test_few_rows(spark, rows):
    one = rows.limit(1)
    assert _fit(one, False).trees[0].value[1] == pytest.approx(one.first().y, abs=1e-5)
    with pytest.raises(ValueError):
        _fit(rows.limit(0), False)
    with pytest.raises(Exception, match="null"):
        _fit(rows.withColumn("y", F.lit(None).cast("double")), False)


def test_thresholds_keep_all_of_few_values(spark):
    df = spark.createDataFrame([([float(i % 40), 0.0 if i else 9.0],) for i in range(4000)], "x array<double>")
    many, few = B.thresholds_of(df, "x", 2)
    assert len(many) == 31 and few.tolist() == [4.5]


def _drawn_rows(rng, sizes, depth, n=3000):
    bins = np.stack([rng.integers(0, s, n).astype(np.uint8) for s in sizes])
    tree = B.Tree(rng.integers(0, len(sizes), 2 << depth), rng.integers(0, 3, 2 << depth), np.zeros(2 << depth), 1.0)
    tree.split[rng.random(2 << depth) < 0.1] = 255
    return tree, bins, rng.integers(-1000, 1000, n).astype(np.int32), (np.array([1.0, 3.0]), rng.integers(0, 2, n).astype(np.uint8))


def test_rows_are_routed_as_by_walking_down():
    tree, bins, *_ = _drawn_rows(np.random.default_rng(1), [32, 5, 2, 9], 9)
    for depth in (0, 1, 5, 6, 7, 9):
        for i, node in list(enumerate(B.routed(tree, bins, depth)))[::31]:
            at = 1
            for _ in range(depth):
                at = 2 * at + int(bins[tree.feature[at], i] > tree.split[at])
            assert node == at


@pytest.mark.parametrize("level", [0, 1, 4, 8])
def test_a_level_adds_up_the_lighter_children_only(level):
    rng = np.random.default_rng(level)
    sizes = [32, 32, 7, 2, 1, 32]
    tree, bins, value, weight = _drawn_rows(rng, sizes, 9)
    side = rng.integers(0, 3, 1 << level - 1).tolist() if level else []
    halves = [(bins[:, a:b], value[a:b], (weight[0], weight[1][a:b])) for a, b in ((0, 1700), (1700, 3000))]
    told = B._by_feature(next(B._sums(tree, level, side, sizes, iter(halves))), sizes)
    node = B.routed(tree, bins, level)
    for i, want in enumerate(side or [None]):
        own = node == 1 if want is None else (node == 2 * ((1 << level - 1) + i) + want) & (want < 2)
        for f in range(len(sizes)):
            assert (told[0, f, i] == np.bincount(bins[f][own], value[own], B.BINS)).all()
            assert (told[1, f, i] == np.bincount(bins[f][own], weight[0][weight[1]][own], B.BINS)).all()
    assert max(np.prod([sizes[f] for f in own]) for own in B._together(sizes)) <= B.CELLS
    assert sorted(f for own in B._together(sizes) for f in own) == list(range(len(sizes)))
