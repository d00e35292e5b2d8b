"""Enrichment stages of the preprocessing chain as their own queries (section 2.9, first half):
hash-seeded rating / review / stock draws for the rows that miss them, and the 1..k rank of top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..oracle.catalog import rnd, with_products, with_scored, z
from ..registry import query
from . import preprocess as P
from .preprocess_queries import topk_products

KEY = ["product_id", "source_store"]


def pre_enrichment(spark: SparkSession, sf: str) -> DataFrame:
    """Filtered, de-duplicated, repaired rows with fixed prices (the input of the draws)."""
    return P.repaired_layer(spark, sf)


def global_params(spark: SparkSession) -> DataFrame:
    """The older single-distribution rule as a parameter table (same row for every segment)."""
    r_mean, r_std, rv_mean, rv_std = C.GLOBAL_RATING_PARAMS
    rows = [(seg, r_mean, r_std, rv_mean, rv_std, *C.STOCK_PARAMS[seg]) for seg in ("low", "mid", "high")]
    return spark.createDataFrame(rows, "_ps string, r_mean double, r_std double, rv_mean double, rv_std double, "
                                       "g_shape double, g_scale double")


def _missing_rows(spark: SparkSession, sf: str, flag: str, params: DataFrame, cap: int) -> DataFrame:
    df = pre_enrichment(spark, sf).withColumn("_missing", F.col(flag).isNull())
    return P.enrich(df, params, review_cap=cap).filter("_missing")


ENRICHED_RATING_SQL = with_scored("SELECT e2.product_id, e2.source_store, e2.rating, e2.review_count FROM e2 "
                                  "JOIN e1 ON e1.product_id = e2.product_id AND e1.source_store = e2.source_store "
                                  "WHERE e1.rating IS NULL")


@query("enrich_rating_reviews", ENRICHED_RATING_SQL)
def q_enrich_rating_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """Rows without a rating: rating ~ clip(N(m, s), 1, 5) rounded 1, reviews ~ clip(int(LogNormal), 1,
    15000), parameters per price segment."""
    rows = _missing_rows(spark, sf, "rating", P.segment_params(spark), C.REVIEW_CAP)
    return rows.select(*KEY, "rating", "review_count")


def _global_sql() -> str:
    key = "(product_id || '|' || source_store)"
    r_mean, r_std, rv_mean, rv_std = C.GLOBAL_RATING_PARAMS
    rating = rnd(rnd(f"least(greatest({r_mean}::DOUBLE + {r_std}::DOUBLE * {z(key, 1)}, 1.0::DOUBLE), 5.0::DOUBLE)", 1), 1)
    reviews = (f"CAST(least(greatest(floor(exp({rv_mean}::DOUBLE + {rv_std}::DOUBLE * {z(key, 3)})), 1), "
               f"{C.GLOBAL_REVIEW_CAP}) AS INT)")
    return with_scored(f"SELECT product_id, source_store, {rating} AS rating, {reviews} AS review_count "
                       f"FROM c7 WHERE rating IS NULL")


@query("enrich_rating_global", _global_sql())
def q_enrich_rating_global(spark: SparkSession, sf: str) -> DataFrame:
    """Older rule: one distribution N(3.9, .7) and LogNormal(4.5, 1.2) capped at 10000 for all rows."""
    rows = _missing_rows(spark, sf, "rating", global_params(spark), C.GLOBAL_REVIEW_CAP)
    return rows.select(*KEY, "rating", "review_count")


@query("enrich_stock", with_scored("SELECT e2.product_id, e2.source_store, e2.stock_qty FROM e2 "
                                   "JOIN e1 ON e1.product_id = e2.product_id AND e1.source_store = e2.source_store "
                                   "WHERE e1.stock_qty IS NULL"))
def q_enrich_stock(spark: SparkSession, sf: str) -> DataFrame:
    """Rows without stock: in stock -> max(1, int(Gamma(shape, scale))) per segment, else 0."""
    rows = _missing_rows(spark, sf, "stock_qty", P.segment_params(spark), C.REVIEW_CAP)
    return rows.select(*KEY, "stock_qty")


TOPK_REPORT_K = 20


@query("topk_rank", with_products(f"""SELECT product_id, source_store, popularity_score,
  row_number() OVER (ORDER BY popularity_score DESC, product_id, source_store) AS rank
FROM (SELECT * FROM products WHERE topk_label = 1 ORDER BY popularity_score DESC, product_id, source_store
      LIMIT {TOPK_REPORT_K}) t"""))
def q_topk_rank(spark: SparkSession, sf: str) -> DataFrame:
    """1..k rank of the report top-k (k = 20): limit first, then number the k survivors."""
    t = topk_products(P.processed_products(spark, sf), TOPK_REPORT_K)
    return t.select(*KEY, "popularity_score", "rank")
