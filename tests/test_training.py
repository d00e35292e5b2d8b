"""The trained models: better than chance, complete, repeatable for a fixed seed. Fewer trees than in production."""

import pytest
from pyspark.sql import functions as F

from vitrine import registry
from vitrine.plans import clustering, ml

from .conftest import SF_SMALL

registry.load_all()
Q = registry.QUERIES


@pytest.fixture(autouse=True)
def few_trees(monkeypatch):
    monkeypatch.setattr(ml, "GBT_PARAMS", {**ml.GBT_PARAMS, "maxIter": 8})
    monkeypatch.setattr(ml, "GBT_REG_PARAMS", {**ml.GBT_REG_PARAMS, "maxIter": 8})
    monkeypatch.setattr(clustering, "N_INIT", 2)


def test_classifier_beats_chance_and_reports_its_threshold(spark):
    r = Q["train_topk_classifier"](spark, SF_SMALL).first()
    n = Q["enforce_types"](spark, SF_SMALL).count()
    assert r.roc_auc > 0.55 and r.n_train + r.n_test == n and 0.15 * n < r.n_test < 0.25 * n
    assert 0 <= r.best_threshold <= 1 and r.best_f1 >= r.f1
    again = Q["train_topk_classifier"](spark, SF_SMALL).first()
    assert again == r


def test_importances_sum_to_one(spark):
    rows = Q["feature_importance"](spark, SF_SMALL).collect()
    assert abs(sum(r.importance for r in rows) - 1) < 1e-6 and len(rows) == len(ml.ALL_FEATURES)
    assert [r.importance for r in rows] == sorted((r.importance for r in rows), reverse=True)


def test_price_regressor_explains_the_price(spark):
    assert Q["train_price_regressor"](spark, SF_SMALL).first().r2 > 0.5


def test_k_selection_marks_one_best(spark):
    rows = Q["k_selection"](spark, SF_SMALL).collect()
    best = max(rows, key=lambda r: r.silhouette)
    assert [r.k for r in rows] == [2, 3, 4, 5, 6] and [r.k for r in rows if r.is_best] == [best.k]


def _kmeans(frame, k):
    from pyspark.ml.clustering import KMeans

    return KMeans(k=k, seed=42, featuresCol="features", predictionCol="cluster_id").fit(frame)


def test_kmeans_is_a_fixed_point_of_lloyds_step(spark):
    """Every point is with its nearest centre, and the clusters are all used."""
    frame = clustering.clustering_frame(spark, SF_SMALL)
    model = _kmeans(frame, 3)
    centres = model.clusterCenters()
    rows = model.transform(frame).select("features", "cluster_id").collect()
    for r in rows[::37]:
        d = [float(((r.features.toArray() - c) ** 2).sum()) for c in centres]
        assert d[r.cluster_id] == min(d)
    assert {r.cluster_id for r in rows} == {0, 1, 2}


def test_pca_components_match_the_covariance(spark):
    import numpy as np

    frame = clustering.clustering_frame(spark, SF_SMALL)
    x = np.stack([r.features.toArray() for r in frame.select("features").collect()])
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    out, ratios = clustering.pca_2d(frame)
    assert abs(ratios[0] - values[0] / values.sum()) < 1e-3 and abs(ratios[1] - values[1] / values.sum()) < 1e-3
    variance = out.select(F.var_samp("PC1"), F.var_samp("PC2")).first()
    assert abs(variance[0] / values[0] - 1) < 1e-3 and abs(variance[1] / values[1] - 1) < 1e-3


def test_isolation_forest_is_repeatable_and_finds_a_far_point(spark):
    rows = [(f"p{i}", float(i % 10), float(i % 7)) for i in range(600)] + [("far", 500.0, -500.0)]
    df = spark.createDataFrame(rows, "key string, x double, y double")
    a = {r.key: r.anomaly_score for r in ml.isolation_forest_scores(df, "key", ["x", "y"], n_trees=40).collect()}
    b = {r.key: r.anomaly_score for r in ml.isolation_forest_scores(df.repartition(7), "key", ["x", "y"], n_trees=40).collect()}
    assert a == b and max(a, key=a.get) == "far"


def test_report_counts_the_steps_that_have_results(spark):
    rows = {(r.section, r.metric): r for r in Q["evaluation_report"](spark, SF_SMALL).collect()}
    assert rows["overall", "steps_done"].grade in ("module complete", "incomplete")
    assert rows["clustering", "silhouette"].grade in ("WELL SEPARATED", "ACCEPTABLE", "OVERLAPPING")
    assert rows["boosted_trees", "roc_auc"].grade is not None
