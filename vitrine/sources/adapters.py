"""Adapter views: product-catalog tables derived from the shared TPC-H-style tables.

The SQL text is shared verbatim by Spark SQL and the DuckDB oracle, so both sides start from the
same rows. ``raw_products`` has one row per line item, so duplicates on (product_id, source_store)
are plentiful; ``_s1.._s5`` is the ingest (keep-first) order and is unique.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .tables import read_table

# The columns of a product, by the tables they are made of.
_ID = """CAST(l.l_partkey AS STRING)                                   AS product_id,"""
_PLATFORM = """       CASE WHEN l.l_suppkey % 2 = 0 THEN 'shopify' ELSE 'woocommerce' END AS source_platform,"""
_STORE = """       'store_' || CAST(l.l_suppkey % 10 AS STRING)                  AS source_store,"""
_NAME = """       p.p_name                                                      AS name,"""
_TEXTS = """       CASE WHEN l.l_suppkey % 4 = 0 THEN NULL
            WHEN l.l_suppkey % 4 = 1 THEN ''
            ELSE '<p>' || p.p_name || ' &amp; <b>' || p.p_type || '</b></p>' END AS description,
       CASE WHEN l.l_partkey % 13 = 0 THEN NULL
            WHEN l.l_partkey % 13 = 1 THEN p.p_type || ' ## extra'
            WHEN l.l_partkey % 13 = 2 THEN p.p_type || '/sub/'
            WHEN l.l_partkey % 13 = 3 THEN ''
            ELSE p.p_type END                                        AS category,"""
_BRAND = """       CASE WHEN l.l_partkey % 11 = 0 THEN NULL
            WHEN l.l_partkey % 11 = 1 THEN p.p_brand || ' | slogan'
            WHEN l.l_partkey % 11 = 2 THEN p.p_brand || '® x'
            ELSE p.p_brand END                                       AS brand,"""
_COUNTS = """       CASE WHEN l.l_returnflag = 'N' THEN NULL
            ELSE CAST(l.l_quantity AS INT) * l.l_linenumber END      AS review_count,
       l.l_linestatus = 'O'                                          AS in_stock,
       CASE WHEN l.l_returnflag = 'A' THEN CAST(l.l_quantity AS INT) END AS stock_qty,"""
_NUMBERS = f"""       CASE WHEN l.l_orderkey % 97 = 0 THEN CAST(0 AS DOUBLE)
            WHEN l.l_orderkey % 97 = 1 THEN NULL
            ELSE floor(l.l_extendedprice / l.l_quantity / 50 * 100 + 0.5) / 100 END AS price,
       CASE WHEN l.l_orderkey % 7 = 0 THEN NULL
            ELSE floor(l.l_extendedprice / l.l_quantity / 50 / (1 - l.l_discount) * 100 + 0.5) / 100 END AS price_original,
       CASE WHEN l.l_returnflag = 'N' THEN NULL
            ELSE 1 + ((l.l_orderkey * 7 + l.l_partkey) % 41) / CAST(10 AS DOUBLE) END AS rating,
{_COUNTS}"""
_COUNTRY = """       n.n_name                                                      AS shop_country,"""
_DAYS = """       CASE WHEN l.l_suppkey % 10 = 5 OR l.l_orderkey % 5 = 0 THEN NULL
            ELSE CAST(DATE '2002-01-01' - CAST(l.l_shipdate AS DATE) AS INT) END AS days_since_publish,"""
_SEQ = """       l.l_orderkey AS _s1, l.l_linenumber AS _s2, l.l_partkey AS _s3, l.l_suppkey AS _s4, l.l_extendedprice AS _s5"""

RAW_PRODUCTS_SQL = f"""
SELECT {_ID}
{_PLATFORM}
{_STORE}
{_NAME}
{_TEXTS}
{_BRAND}
{_NUMBERS}
{_COUNTRY}
{_DAYS}
{_SEQ}
FROM lineitem l
JOIN part p     ON p.p_partkey = l.l_partkey
JOIN supplier s ON s.s_suppkey = l.l_suppkey
JOIN nation n   ON n.n_nationkey = s.s_nationkey
"""

# The part of a product that its line item alone gives, as narrow as keep-first can order it: keys as numbers, prices
# in cents, a rating as whether there is one.
LINES_SQL = f"""
SELECT l.l_partkey AS _s3, l.l_suppkey % 10 AS _store, l.l_orderkey AS _s1, l.l_linenumber AS _s2, l.l_suppkey AS _s4,
       l.l_extendedprice AS _s5,
       CASE WHEN l.l_orderkey % 97 = 0 THEN 0
            WHEN l.l_orderkey % 97 = 1 THEN NULL
            ELSE floor(l.l_extendedprice / l.l_quantity / 50 * 100 + 0.5) END AS _cents,
       CASE WHEN l.l_orderkey % 7 = 0 THEN NULL
            ELSE floor(l.l_extendedprice / l.l_quantity / 50 / (1 - l.l_discount) * 100 + 0.5) END AS _cents_original,
       CASE WHEN l.l_returnflag = 'N' OR l.l_orderkey IS NULL THEN NULL ELSE TRUE END AS _rated,
{_COUNTS}
{_DAYS.rstrip(",")}
FROM lineitem l WHERE l.l_partkey IS NOT NULL
"""

# Those columns as a product has them.
OFFERS_SQL = """
SELECT l.* EXCEPT (_store, _cents, _cents_original, _rated), CAST(_s3 AS STRING) AS product_id,
       'store_' || CAST(_store AS STRING) AS source_store, _cents / 100 AS price, _cents_original / 100 AS price_original,
       CASE WHEN _rated THEN 1 + ((_s1 * 7 + _s3) % 41) / CAST(10 AS DOUBLE) END AS rating
FROM {lines} l
"""

# What its part gives: first what the second keep-first asks for and what the rest is made of, then the rest.
NAMED_SQL = f"""
SELECT l.* EXCEPT (l_partkey),
{_NAME}
{_BRAND}
       p.p_type
FROM (SELECT *, _s3 AS l_partkey FROM {{lines}}) l JOIN {{parts}} p ON p.p_partkey = l.l_partkey
"""
DESCRIBED_SQL = f"""
SELECT l.product_id,
{_PLATFORM}
       l.source_store, l.name,
{_TEXTS}
       l.brand, l.price, l.price_original, l.rating, l.review_count, l.in_stock, l.stock_qty, l.n_name AS shop_country,
       l.days_since_publish, l._s1, l._s2, l._s3, l._s4, l._s5
FROM (SELECT k.*, _s3 AS l_partkey, _s4 AS l_suppkey, struct(name AS p_name, p_type) AS p FROM {{kept}} k) l
"""

SEQ_COLS = ["_s1", "_s2", "_s3", "_s4", "_s5"]

RAW_PRODUCT_COLS = [
    "product_id", "source_platform", "source_store", "name", "description", "category", "brand",
    "price", "price_original", "rating", "review_count", "in_stock", "stock_qty", "shop_country",
    "days_since_publish",
]

# Baskets: one transaction per order, items are the part types bought in it.
ORDER_BASKETS_SQL = """
SELECT l.l_orderkey AS basket_id, p.p_type AS item
FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey
"""

# Variants: one row per (part, supplier) offer; the product is the part.
RAW_VARIANTS_SQL = """
SELECT CAST(l.l_partkey AS STRING)                                          AS product_id,
       CAST(l.l_partkey AS STRING) || '-' || CAST(l.l_suppkey AS STRING)   AS variant_id,
       'SKU-' || CAST(l.l_partkey AS STRING) || '-' || CAST(l.l_linenumber AS STRING) AS sku,
       CASE WHEN l.l_linenumber % 3 = 0 THEN NULL ELSE 'Size ' || CAST(l.l_linenumber AS STRING) END AS option_value,
       floor(l.l_extendedprice / l.l_quantity / 50 * 100 + 0.5) / 100    AS price,
       CASE WHEN l.l_linestatus = 'O' THEN TRUE WHEN l.l_returnflag = 'A' THEN NULL ELSE FALSE END AS available,
       l.l_linenumber                                                      AS position,
       l.l_orderkey AS _s1, l.l_linenumber AS _s2, l.l_partkey AS _s3, l.l_suppkey AS _s4, l.l_extendedprice AS _s5
FROM lineitem l
"""


def _with_views(spark: SparkSession, sf_dir: str, names) -> None:
    for name in names:
        read_table(spark, sf_dir, name).createOrReplaceTempView(name)


def raw_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The landed product table (18-column contract minus derived fields, plus ``_s1.._s5``)."""
    _with_views(spark, sf_dir, ["lineitem", "part", "supplier", "nation"])
    return spark.sql(RAW_PRODUCTS_SQL)


#: Suppliers are broadcast up to this many, beyond it joined by a shuffle.
SELLER_BROADCAST_ROWS = 1_000_000


def sellers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s_suppkey, n_name): a row per supplier whose nation is there (the least name where one comes twice)."""
    s, n = read_table(spark, sf_dir, "supplier"), read_table(spark, sf_dir, "nation")
    found = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("s_suppkey").agg(F.min("n_name").alias("n_name"))
    found = materialize(found.where(F.col("s_suppkey").isNotNull()), "sellers")
    return F.broadcast(found) if found.count() <= SELLER_BROADCAST_ROWS else found


def offer_lines(spark: SparkSession, sf_dir: str, sold_by: DataFrame) -> DataFrame:
    """``raw_products`` of the suppliers that are there, without the columns that other tables give, in the narrow form
    that keep-first sorts and sends. A part that isn't there goes with all its offers in ``named``."""
    _with_views(spark, sf_dir, ["lineitem"])
    return spark.sql(LINES_SQL).join(sold_by.select(F.col("s_suppkey").alias("_s4")), "_s4", "left_semi")


def offers(lines: DataFrame) -> DataFrame:
    """Lines with the keys, prices and ratings of ``raw_products``."""
    return lines.sparkSession.sql(OFFERS_SQL, lines=lines)


def raw_offers(spark: SparkSession, sf_dir: str, sold_by: DataFrame) -> DataFrame:
    """``raw_products`` of the suppliers that are there, without the columns that other tables give."""
    return offers(offer_lines(spark, sf_dir, sold_by))


def named(spark: SparkSession, sf_dir: str, lines: DataFrame) -> DataFrame:
    """Lines with name, brand and type of their part: one row each, also where a part comes twice."""
    parts = read_table(spark, sf_dir, "part").groupBy("p_partkey").agg(F.min(F.struct("p_name", "p_type", "p_brand")).alias("d"))
    return spark.sql(NAMED_SQL, lines=lines, parts=parts.select("p_partkey", "d.*"))


def described(kept: DataFrame) -> DataFrame:
    """Named offers as rows of ``raw_products``."""
    return kept.sparkSession.sql(DESCRIBED_SQL, kept=kept)


def raw_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    _with_views(spark, sf_dir, ["lineitem"])
    return spark.sql(RAW_VARIANTS_SQL)


def order_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    _with_views(spark, sf_dir, ["lineitem", "part"])
    return spark.sql(ORDER_BASKETS_SQL)

