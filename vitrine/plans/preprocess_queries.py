"""Registered queries for the preprocessing chain and its scalar functions (sections 2.3, 2.6, 2.7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions import numeric as N
from ..functions import text as T
from ..operators.dedup import dedup_keep_first
from ..operators.ranking import rank_min, top_k
from ..oracle.catalog import (caps_sql, clean_pages_sql, rnd, seg_sql, with_products, with_raw, with_scored)
from ..registry import query
from ..session import materialize
from ..sources.adapters import SEQ_COLS, raw_offers, raw_products, sellers
from ..sources.tables import read_table
from . import preprocess as P

SEQ = ", ".join(SEQ_COLS)
TOPK_K = 100


def topk_products(products: DataFrame, k: int = TOPK_K) -> DataFrame:
    """label = 1, best ``k`` by popularity (ties by key), ranked 1..k."""
    order = [F.col("popularity_score").desc(), F.col("product_id").asc(), F.col("source_store").asc()]
    return top_k(products.filter(F.col("topk_label") == 1), order, k, rank_col="rank")


TOPK_SQL = f"""SELECT *, row_number() OVER (ORDER BY popularity_score DESC, product_id, source_store) AS rank
FROM (SELECT * FROM products WHERE topk_label = 1 ORDER BY popularity_score DESC, product_id, source_store
      LIMIT {TOPK_K}) t"""


@query("topk_products", with_products(TOPK_SQL))
def q_topk_products(spark: SparkSession, sf: str) -> DataFrame:
    return topk_products(P.processed_products(spark, sf))


@query("enforce_types", with_products("SELECT * FROM products"))
def q_enforce_types(spark: SparkSession, sf: str) -> DataFrame:
    """The processed 20-column table (final subset, order, rounding and types)."""
    return P.processed_products(spark, sf)


@query("filter_valid_price", with_raw(f"SELECT product_id, source_store, price, {SEQ} FROM raw_products WHERE price > 0"))
def q_filter_valid_price(spark: SparkSession, sf: str) -> DataFrame:
    return P.filter_valid_price(raw_products(spark, sf)).select("product_id", "source_store", "price", *SEQ_COLS)


@query("dedup_keep_first", with_raw(f"""SELECT product_id, source_store, name, brand, price, {SEQ} FROM (
  SELECT *, row_number() OVER (PARTITION BY name, brand, price ORDER BY {SEQ}) AS rn2 FROM (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id, source_store ORDER BY {SEQ}) AS rn
                   FROM raw_products WHERE price > 0) a WHERE rn = 1) b) c WHERE rn2 = 1"""))
def q_dedup_keep_first(spark: SparkSession, sf: str) -> DataFrame:
    return P.kept_offers(spark, sf).select("product_id", "source_store", "name", "brand", "price", *SEQ_COLS)


@query("dedup_simple", with_raw(f"""SELECT product_id, source_store, price, {SEQ} FROM (
  SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY {SEQ}) AS rn FROM raw_products) a
WHERE rn = 1 AND price > 0"""))
def q_dedup_simple(spark: SparkSession, sf: str) -> DataFrame:
    """Dedup on product_id first, then the price filter (the other order gives other rows)."""
    offers = raw_offers(spark, sf, sellers(spark, sf)).select("product_id", "source_store", "price", *SEQ_COLS)
    df = P.filter_valid_price(dedup_keep_first(offers, ["product_id"], SEQ_COLS))
    df = materialize(df, "dedup_simple", P.CATALOG_SPLIT)
    # a part that isn't there goes with all its offers
    parts = read_table(spark, sf, "part").select("p_partkey")
    return df.join(parts, F.col("_s3") == F.col("p_partkey"), "left_semi")


@query("clean_html", clean_pages_sql())
def q_clean_html(spark: SparkSession, sf: str) -> DataFrame:
    """All entities decoded, tags stripped, whitespace collapsed, over whole pages."""
    return read_table(spark, sf, "pages").select("page_id", T.clean_html("html").alias("text"))


@query("normalize_category", with_raw(f"""SELECT product_id, source_store, {SEQ}, category AS category_raw,
  CASE WHEN lower(trim(split_part(trim(split_part(trim(coalesce(category, 'uncategorized')), '##', 1)), '/', 1))) = ''
       THEN 'uncategorized'
       ELSE lower(trim(split_part(trim(split_part(trim(coalesce(category, 'uncategorized')), '##', 1)), '/', 1))) END
  AS category FROM raw_products"""))
def q_normalize_category(spark: SparkSession, sf: str) -> DataFrame:
    df = raw_products(spark, sf)
    return df.select("product_id", "source_store", *SEQ_COLS, F.col("category").alias("category_raw"),
                     T.normalize_category("category").alias("category"))


@query("normalize_brand", with_raw(f"""SELECT product_id, source_store, {SEQ}, brand AS brand_raw,
  CASE WHEN trim(split_part(trim(split_part(trim(coalesce(brand, 'unknown')), '|', 1)), '®', 1)) = '' THEN 'unknown'
       ELSE trim(split_part(trim(split_part(trim(coalesce(brand, 'unknown')), '|', 1)), '®', 1)) END AS brand
  FROM raw_products"""))
def q_normalize_brand(spark: SparkSession, sf: str) -> DataFrame:
    df = raw_products(spark, sf)
    return df.select("product_id", "source_store", *SEQ_COLS, F.col("brand").alias("brand_raw"),
                     T.normalize_brand("brand").alias("brand"))


@query("description_fallback", with_scored(f"SELECT product_id, source_store, description FROM scored"))
def q_description_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Clean description, else 'name — category | brand' over the repaired catalog."""
    return P.scored_layer(spark, sf).select("product_id", "source_store", "description")


def _tag_rule_sql(tags: str) -> str:
    whens = " ".join(f"WHEN contains(lower({tags}), '{kw}') THEN '{cat}'" for kw, cat in C.TAG_CATEGORY_RULES)
    return f"CASE {whens} ELSE '{C.DEFAULT_TAG_CATEGORY}' END"


@query("infer_category_from_tags", f"""SELECT doc_id, {_tag_rule_sql('text')} AS category FROM documents""")
def q_infer_category_from_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Ordered keyword rules over whole document texts used as tag strings (first hit wins)."""
    docs = read_table(spark, sf, "documents")
    return docs.select("doc_id", T.infer_category_from_tags("text").alias("category"))


# FIXED VALUES: manual category remap (identity for anything not listed).
CATEGORY_MAP = [
    ("womens shorts", "apparel"),
    ("mens clothing", "apparel"),
    ("bottoms", "apparel"),
    ("shoes", "footwear"),
    ("phone case", "accessories"),
    ("hubs", "electronics"),
    ("sample", "other"),
    ("sportswear", "fitness"),
    ("", "uncategorized"),
]


def map_category(df: DataFrame, mapping=CATEGORY_MAP, col: str = "category") -> DataFrame:
    """Dictionary remap through a broadcast join with the (fixed-size) mapping table."""
    m = df.sparkSession.createDataFrame(mapping, f"_from string, _to string")
    out = df.join(F.broadcast(m), F.col(col) == F.col("_from"), "left")
    return out.withColumn(col, F.coalesce(F.col("_to"), F.col(col))).drop("_from", "_to")


def _map_sql() -> str:
    vals = ", ".join(f"('{a}', '{b}')" for a, b in CATEGORY_MAP)
    return with_products(f"""SELECT p.product_id, p.source_store, coalesce(m._to, p.category) AS category
FROM products p LEFT JOIN (SELECT * FROM (VALUES {vals}) t(_from, _to)) m ON p.category = m._from""")


@query("map_category", _map_sql())
def q_map_category(spark: SparkSession, sf: str) -> DataFrame:
    return map_category(P.processed_products(spark, sf)).select("product_id", "source_store", "category")


@query("fix_price_original", with_raw(f"""SELECT product_id, source_store, {SEQ},
  CASE WHEN price_original IS NULL OR price_original < price THEN price ELSE price_original END AS price_original
  FROM raw_products WHERE price > 0"""))
def q_fix_price_original(spark: SparkSession, sf: str) -> DataFrame:
    df = P.filter_valid_price(raw_products(spark, sf))
    return df.select("product_id", "source_store", *SEQ_COLS, N.fix_price_original().alias("price_original"))


@query("recompute_discount", with_raw(f"""SELECT product_id, source_store, {SEQ},
  CASE WHEN po > price THEN {rnd('(po - price) / po * 100.0::DOUBLE', 1)} ELSE 0.0::DOUBLE END AS discount_pct,
  (CASE WHEN po > price THEN {rnd('(po - price) / po * 100.0::DOUBLE', 1)} ELSE 0.0::DOUBLE END) > 0 AS is_on_promo
  FROM (SELECT *, CASE WHEN price_original IS NULL OR price_original < price THEN price ELSE price_original END AS po
        FROM raw_products WHERE price > 0) t"""))
def q_recompute_discount(spark: SparkSession, sf: str) -> DataFrame:
    """Discount from the repaired prices and the promo flag derived from it."""
    df = P.fix_prices(P.filter_valid_price(raw_products(spark, sf)))
    return df.select("product_id", "source_store", *SEQ_COLS, "discount_pct",
                     (F.col("discount_pct") > 0).alias("is_on_promo"))


@query("promo_flag", with_products("SELECT product_id, source_store, discount_pct, is_on_promo FROM products"))
def q_promo_flag(spark: SparkSession, sf: str) -> DataFrame:
    return P.processed_products(spark, sf).select("product_id", "source_store", "discount_pct",
                                                   (F.col("discount_pct") > 0).alias("is_on_promo"))


@query("price_segment", with_raw(f"SELECT product_id, source_store, {SEQ}, price, {seg_sql()} AS price_segment "
                                 f"FROM raw_products WHERE price > 0"))
def q_price_segment(spark: SparkSession, sf: str) -> DataFrame:
    df = P.filter_valid_price(raw_products(spark, sf))
    return df.select("product_id", "source_store", *SEQ_COLS, "price", N.price_segment("price").alias("price_segment"))


@query("rank_min_desc", with_scored("""SELECT product_id, source_store, review_count,
  CAST(rank() OVER (ORDER BY review_count DESC) AS BIGINT) AS review_rank FROM scored"""))
def q_rank_min_desc(spark: SparkSession, sf: str) -> DataFrame:
    """Rank (method min, descending) of review_count over all scored rows, without a one-task window."""
    df = P.scored_layer(spark, sf).select("product_id", "source_store", "review_count")
    return rank_min(df, "review_count", "review_rank", descending=True)


@query("popularity_score", with_scored("SELECT product_id, source_store, rating, review_count, popularity_score FROM scored"))
def q_popularity_score(spark: SparkSession, sf: str) -> DataFrame:
    return P.scored_layer(spark, sf).select(
        "product_id", "source_store", "rating", "review_count", "popularity_score")


@query("cap_per_source", with_products("""SELECT source_store, count(*) AS n_rows, max(popularity_score) AS best,
  min(popularity_score) AS worst FROM products GROUP BY source_store""", C.CAPPED_PROFILE))
def q_cap_per_source(spark: SparkSession, sf: str) -> DataFrame:
    """Rows kept per store after the cap, with the best and worst kept score."""
    df = P.processed_products(spark, sf, C.CAPPED_PROFILE)
    return df.groupBy("source_store").agg(F.count(F.lit(1)).alias("n_rows"),
                                          F.max("popularity_score").alias("best"),
                                          F.min("popularity_score").alias("worst"))


@query("lookup_cap_join", with_scored(f"""SELECT s.source_store, k.cap, count(*) AS n_candidates
FROM scored s JOIN {caps_sql()} k ON s.source_store = k.source_store GROUP BY s.source_store, k.cap"""))
def q_lookup_cap_join(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates per store joined to the cap table (stores without a cap drop out)."""
    scored = P.scored_layer(spark, sf)
    caps = P.store_caps(spark, C.CAPPED_PROFILE)
    return scored.join(F.broadcast(caps), "source_store", "inner") \
                 .groupBy("source_store", "cap").agg(F.count(F.lit(1)).alias("n_candidates"))


@query("topk_label", with_products("""SELECT topk_label, count(*) AS n, min(popularity_score) AS min_score,
  max(popularity_score) AS max_score FROM products GROUP BY topk_label""", C.CAPPED_PROFILE))
def q_topk_label(spark: SparkSession, sf: str) -> DataFrame:
    """Label balance against the interpolated 80 % quantile of the capped set."""
    df = P.processed_products(spark, sf, C.CAPPED_PROFILE)
    return df.groupBy("topk_label").agg(F.count(F.lit(1)).alias("n"), F.min("popularity_score").alias("min_score"),
                                        F.max("popularity_score").alias("max_score"))


@query("median_fill", with_scored("""SELECT source_store, count(*) AS n, min(days_since_publish) AS min_days,
  max(days_since_publish) AS max_days, sum(days_since_publish) AS sum_days FROM scored GROUP BY source_store"""))
def q_median_fill(spark: SparkSession, sf: str) -> DataFrame:
    df = P.scored_layer(spark, sf)
    return df.groupBy("source_store").agg(F.count(F.lit(1)).alias("n"), F.min("days_since_publish").alias("min_days"),
                                          F.max("days_since_publish").alias("max_days"),
                                          F.sum("days_since_publish").alias("sum_days"))


@query("segment_params_join", with_scored(f"""SELECT price_segment, count(*) AS n,
  {rnd('avg(rating)', 4)} AS avg_rating, {rnd('avg(ln(1.0::DOUBLE + review_count))', 4)} AS avg_log_reviews,
  {rnd('avg(stock_qty)', 4)} AS avg_stock FROM scored GROUP BY price_segment"""))
def q_segment_params_join(spark: SparkSession, sf: str) -> DataFrame:
    """Per-segment moments after the segment-parameter join drove the synthetic draws."""
    df = P.scored_layer(spark, sf)
    return df.groupBy("price_segment").agg(
        F.count(F.lit(1)).alias("n"), N.round_half_up(F.avg("rating"), 4).alias("avg_rating"),
        N.round_half_up(F.avg(N.log1p_("review_count")), 4).alias("avg_log_reviews"),
        N.round_half_up(F.avg("stock_qty"), 4).alias("avg_stock"))


# Date strings in every accepted layout (and one rejected) derived from the orders table.
DATE_LAYOUT_SQL_SPARK = """CASE o_orderkey % 6
  WHEN 0 THEN date_format(o_orderdate, "yyyy-MM-dd'T'HH:mm:ss") || '+00:00'
  WHEN 1 THEN date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss')
  WHEN 2 THEN date_format(o_orderdate, "yyyy-MM-dd'T'HH:mm:ss") || '.123456Z'
  WHEN 3 THEN date_format(o_orderdate, 'yyyy-MM-dd')
  WHEN 4 THEN date_format(o_orderdate, "yyyy-MM-dd'T'HH:mm:ss")
  ELSE date_format(o_orderdate, "yyyy-MM-dd'T'HH:mm:ss") || '+0200' END"""


@query("days_since", f"""SELECT o_orderkey,
  CASE WHEN o_orderkey % 6 = 4 THEN NULL
       ELSE CAST(floor(date_diff('microsecond',
            CASE WHEN o_orderkey % 6 = 5 THEN o_orderdate - INTERVAL 2 HOUR
                 WHEN o_orderkey % 6 = 2 THEN o_orderdate + INTERVAL 123456 MICROSECOND ELSE o_orderdate END,
            TIMESTAMP '{C.AS_OF}') / 86400000000.0) AS INT) END AS days_since_publish
FROM orders""")
def q_days_since(spark: SparkSession, sf: str) -> DataFrame:
    """Whole days to ``as_of`` from date strings in the accepted layouts (a zoneless 'T' time is null)."""
    o = read_table(spark, sf, "orders")
    s = o.select("o_orderkey", F.expr(DATE_LAYOUT_SQL_SPARK).alias("published_at"))
    return s.select("o_orderkey", N.days_since("published_at").alias("days_since_publish"))
