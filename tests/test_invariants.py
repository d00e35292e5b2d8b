"""Invariants of the model jobs (no oracle possible) and partition-count independence."""

import pytest
from pyspark.sql import functions as F

from vitrine import registry

from .conftest import SF_SMALL

registry.load_all()
Q = registry.QUERIES


def test_kmeans_segments_named_and_complete(spark):
    c = Q["kmeans_segments"](spark, SF_SMALL)
    p = Q["enforce_types"](spark, SF_SMALL)
    assert c.count() == p.count()
    segs = {r.segment for r in c.select("segment").distinct().collect()}
    assert segs == {"budget", "mid_range", "premium"}
    prof = Q["cluster_profiles"](spark, SF_SMALL).orderBy("mean_price").collect()
    assert [r.segment for r in prof] == ["budget", "mid_range", "premium"]


def test_isolation_forest_share_and_range(spark):
    s = Q["isolation_forest"](spark, SF_SMALL)
    r = s.agg(F.avg(F.col("is_anomaly").cast("double")).alias("share"), F.min("anomaly_score").alias("lo"),
              F.max("anomaly_score").alias("hi")).first()
    assert 0.05 <= r.share <= 0.15
    assert 0.0 < r.lo <= r.hi < 1.0


def test_pca_and_silhouette_ranges(spark):
    from vitrine.plans.clustering import clustering_frame, pca_2d

    _, ratios = pca_2d(clustering_frame(spark, SF_SMALL))
    assert 0.0 <= ratios[1] <= ratios[0] <= 1.0 and ratios[0] + ratios[1] <= 1.0 + 1e-9
    sil = Q["silhouette"](spark, SF_SMALL).first()
    assert -1.0 <= sil.silhouette <= 1.0 and 0 < sil.std_error < 0.1


@pytest.mark.parametrize("name", ["dedup_keep_first", "stratified_split", "rank_min_desc", "source_quality"])
def test_same_result_under_other_partition_counts(spark, name):
    from vitrine.oracle.harness import rows_of

    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        a = rows_of(Q[name](spark, SF_SMALL).toPandas())
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        b = rows_of(Q[name](spark, SF_SMALL).toPandas())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert a == b
