"""Evaluation report: model metrics graded against fixed bounds, one long-form table (section 2.9),
and the dashboard KPIs with the anomaly figures attached."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions.numeric import round_half_up
from ..oracle.catalog import rnd, with_products_ctes
from ..registry import query
from .bi import KPIS_SELECT, kpis
from .clustering import DBSCAN_CTES, anomaly_points
from .preprocess import processed_products

# FIXED VALUES: grade labels.
AUC_LABELS = ["EXCELLENT", "GOOD", "ACCEPTABLE", "NEEDS WORK"]
SILHOUETTE_LABELS = ["WELL SEPARATED", "ACCEPTABLE", "OVERLAPPING"]
ANOMALY_NOTES = ["normal", "check anomalies — may indicate data quality issues", "acceptable"]
RULE_LABELS = ["RICH", "MODERATE", "SPARSE"]
STEPS = ["Feature engineering (label enc + scaling + split)", "Boosted-tree classification",
         "KMeans segmentation (3 clusters)", "DBSCAN anomaly detection", "PCA 2D visualization",
         "Association rules (FP-Growth)"]


def auc_grade(v: F.Column) -> F.Column:
    a, b, c = C.AUC_GRADES
    return (F.when(v >= a, AUC_LABELS[0]).when(v >= b, AUC_LABELS[1]).when(v >= c, AUC_LABELS[2])
            .otherwise(AUC_LABELS[3]))


def silhouette_grade(v: F.Column) -> F.Column:
    a, b = C.SILHOUETTE_GRADES
    return F.when(v >= a, SILHOUETTE_LABELS[0]).when(v >= b, SILHOUETTE_LABELS[1]).otherwise(SILHOUETTE_LABELS[2])


def anomaly_note(pct: F.Column) -> F.Column:
    lo, hi = C.ANOMALY_PCT_BOUNDS
    return F.when(pct < lo, ANOMALY_NOTES[0]).when(pct > hi, ANOMALY_NOTES[1]).otherwise(ANOMALY_NOTES[2])


def rules_grade(n: F.Column) -> F.Column:
    a, b = C.RULE_COUNT_GRADES
    return F.when(n >= a, RULE_LABELS[0]).when(n >= b, RULE_LABELS[1]).otherwise(RULE_LABELS[2])


def anomaly_stats(anomalies: DataFrame) -> DataFrame:
    return anomalies.agg(F.count_if("is_noise").alias("n_anomalies"),
                         round_half_up(F.count_if("is_noise") / F.count(F.lit(1)) * F.lit(100.0), 2).alias("anomaly_pct"))


@query("kpis_models", with_products_ctes(DBSCAN_CTES + f""",
k AS ({KPIS_SELECT}),
a AS (SELECT count(*) FILTER (WHERE is_noise) AS n_anomalies,
      {rnd('count(*) FILTER (WHERE is_noise) / CAST(count(*) AS DOUBLE) * 100.0::DOUBLE', 2)} AS anomaly_pct FROM anom)
SELECT * FROM k CROSS JOIN a"""))
def q_kpis_models(spark: SparkSession, sf: str) -> DataFrame:
    """Dashboard KPIs with the anomaly count and share passed through from the DBSCAN output."""
    return kpis(processed_products(spark, sf), anomaly_stats(anomaly_points(spark, sf)))


def evaluation_report(spark: SparkSession, sf: str) -> DataFrame:
    from .clustering import K, clustering_frame, pca_2d, silhouettes_of
    from .ml import q_train_topk_classifier, training_frame
    from .rules import union_rules

    metrics = q_train_topk_classifier(spark, sf).select("roc_auc", "accuracy", "f1").first()
    sil = silhouettes_of(spark, sf, [K])[K][0]
    _, pca_ratios = pca_2d(clustering_frame(spark, sf))
    an = anomaly_stats(anomaly_points(spark, sf)).first()
    n_rules = union_rules(spark, sf).count()
    n_features = training_frame(spark, sf).limit(1).count()
    # a step is done when its result is there: features, classifier, clusters, anomalies, PCA, rules
    done = [n_features > 0, metrics["roc_auc"] is not None, sil == sil, an["n_anomalies"] is not None,
            pca_ratios[0] == pca_ratios[0], n_rules > 0]
    rows = [
        ("boosted_trees", "roc_auc", float(metrics["roc_auc"])), ("boosted_trees", "accuracy", float(metrics["accuracy"])),
        ("boosted_trees", "f1_score", float(metrics["f1"])), ("clustering", "silhouette", float(sil)),
        ("clustering", "anomalies", float(an["n_anomalies"])), ("clustering", "anomaly_pct", float(an["anomaly_pct"])),
        ("clustering", "pca_variance", float(round(pca_ratios[0] + pca_ratios[1], 4))),
        ("association_rules", "total_rules", float(n_rules)), ("overall", "steps_done", float(sum(done))),
    ]
    df = spark.createDataFrame(rows, "section string, metric string, value double")
    v = F.col("value")
    grade = (F.when(F.col("metric") == "roc_auc", auc_grade(v))
             .when(F.col("metric") == "silhouette", silhouette_grade(v))
             .when(F.col("metric") == "anomaly_pct", anomaly_note(v))
             .when(F.col("metric") == "total_rules", rules_grade(v))
             .when(F.col("metric") == "steps_done", F.when(v == len(STEPS), "module complete").otherwise("incomplete")))
    return df.withColumn("grade", grade)


@query("evaluation_report")
def q_evaluation_report(spark: SparkSession, sf: str) -> DataFrame:
    """Classifier, clustering, anomaly and rule metrics with their grades, in one table (run last)."""
    return evaluation_report(spark, sf)


@query("kpis_dashboard")
def q_kpis_dashboard(spark: SparkSession, sf: str) -> DataFrame:
    """Dashboard KPIs with the four model metrics passed through: classifier ROC-AUC and accuracy
    (test split), KMeans silhouette and the DBSCAN anomaly count."""
    from .clustering import K, silhouettes_of
    from .ml import q_train_topk_classifier

    sil = silhouettes_of(spark, sf, [K])[K][0]
    an = anomaly_stats(anomaly_points(spark, sf))
    metrics = q_train_topk_classifier(spark, sf).select(
        F.col("roc_auc").alias("xgb_roc_auc"), F.col("accuracy").alias("xgb_accuracy"),
        F.lit(sil).alias("silhouette"), an.select("n_anomalies").scalar().alias("n_anomalies"))
    return kpis(processed_products(spark, sf), metrics)
