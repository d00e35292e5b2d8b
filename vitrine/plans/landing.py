"""Landed product rows: the adapter view plus the ingest-time derived fields (18-column contract)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..sources.adapters import raw_products

PRODUCT_CONTRACT = [
    "product_id", "source_platform", "source_store", "name", "description", "category", "brand",
    "price", "price_original", "discount_pct", "rating", "review_count", "in_stock", "stock_qty",
    "shop_country", "days_since_publish", "is_on_promo", "price_segment",
]
VARIANT_CONTRACT = ["product_id", "variant_id", "sku", "option_value", "price", "available", "position"]


def product_defaults(df: DataFrame) -> DataFrame:
    """Ingest-time derived fields: original := original or price (0 counts as missing), unrounded
    discount, promo flag and the left-closed ingest price segment."""
    p = F.col("price")
    po = F.coalesce(F.nullif(F.col("price_original"), F.lit(0.0)), p)
    df = df.withColumn("price_original", po)
    df = df.withColumn("discount_pct", N.ingest_discount())
    return (df.withColumn("is_on_promo", F.col("discount_pct") > 0)
              .withColumn("price_segment", F.when(p.isNull(), F.lit(None)).otherwise(N.ingest_price_segment())))


def landed_products(spark: SparkSession, sf_dir: str, keep_seq: bool = False) -> DataFrame:
    df = product_defaults(raw_products(spark, sf_dir))
    cols = PRODUCT_CONTRACT + (["_s1", "_s2", "_s3", "_s4", "_s5"] if keep_seq else [])
    return df.select(*cols)


LANDED_SQL_COLS = """product_id, source_platform, source_store, name, description, category, brand, price,
       coalesce(nullif(price_original, 0), price) AS price_original,
       CASE WHEN coalesce(nullif(price_original, 0), price) > price
            THEN (coalesce(nullif(price_original, 0), price) - price) / coalesce(nullif(price_original, 0), price) * 100.0::DOUBLE
            ELSE 0.0::DOUBLE END AS discount_pct,
       rating, review_count, in_stock, stock_qty, shop_country, days_since_publish"""


def landed_cte() -> str:
    """SQL CTE ``landed`` (needs ``raw_products``)."""
    return f"""landed AS (SELECT *, discount_pct > 0 AS is_on_promo,
       CASE WHEN price IS NULL THEN NULL WHEN price < 30 THEN 'low' WHEN price < 100 THEN 'mid' ELSE 'high' END AS price_segment
       FROM (SELECT {LANDED_SQL_COLS} FROM raw_products) x)"""
