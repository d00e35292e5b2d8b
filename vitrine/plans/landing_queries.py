"""Registered payload-mapping queries (section 2.2). The oracle derives the expected rows directly
from the source tables, without the JSON round trip the Spark jobs go through."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..registry import query
from ..sources import payloads as PL
from .landing import PRODUCT_CONTRACT, VARIANT_CONTRACT, product_defaults


def _r(expr: str, d: int) -> str:
    s = repr(float(10 ** d))
    return f"(floor(({expr}) * {s}::DOUBLE + 0.5::DOUBLE) / {s}::DOUBLE)"


def _days_sql(k: str, ts: str) -> str:
    return (f"CASE WHEN {k} % 4 = 1 THEN NULL WHEN {k} % 4 = 3 THEN CAST(floor(date_diff('second', date_trunc('day', {ts}), "
            f"TIMESTAMP '{C.AS_OF}') / 86400.0) AS INT) ELSE CAST(floor(date_diff('second', {ts}, TIMESTAMP '{C.AS_OF}') / 86400.0) AS INT) END")


SHOPIFY_PRE_SQL = f"""first_line AS (SELECT * FROM (SELECT l.*, row_number() OVER (PARTITION BY l_orderkey
      ORDER BY l_linenumber, 'SKU-' || CAST(l_partkey AS VARCHAR), CAST({_r('l_extendedprice / l_quantity', 2)} AS VARCHAR)) AS rn FROM lineitem l) t WHERE rn = 1),
stock AS (SELECT l_orderkey, bool_or(l_linestatus = 'O') AS in_stock FROM lineitem GROUP BY l_orderkey),
shopify_pre AS (SELECT CAST(o.o_orderkey AS VARCHAR) AS product_id, 'shopify' AS source_platform, 'shop_orders' AS source_store,
      'Order ' || CAST(o.o_orderkey AS VARCHAR) AS name, o.o_orderpriority || ' & more' AS description,
      CASE WHEN o.o_orderkey % 7 <> 0 THEN o.o_orderpriority ELSE 'uncategorized' END AS category,
      'Vendor ' || CAST(o.o_custkey % 50 AS VARCHAR) AS brand,
      {_r('f.l_extendedprice / f.l_quantity', 2)} AS price,
      CASE WHEN f.l_discount >= 0.05 THEN {_r('f.l_extendedprice / f.l_quantity / (1.0::DOUBLE - f.l_discount)', 2)}
           ELSE {_r('f.l_extendedprice / f.l_quantity', 2)} END AS price_original,
      CAST(NULL AS DOUBLE) AS rating, CAST(NULL AS INT) AS review_count, s.in_stock, CAST(NULL AS INT) AS stock_qty,
      'US' AS shop_country, {_days_sql('o.o_orderkey', 'o.o_orderdate')} AS days_since_publish
      FROM orders o JOIN first_line f ON o.o_orderkey = f.l_orderkey JOIN stock s ON o.o_orderkey = s.l_orderkey
      WHERE o.o_orderkey % 101 <> 0 AND o.o_orderkey % 53 <> 0 AND o.o_orderkey % 31 <> 0)"""

WOO_PRE_SQL = f"""woo_pre AS (SELECT CAST(p_partkey AS VARCHAR) AS product_id, 'woocommerce' AS source_platform, 'woo_parts' AS source_store,
      p_name AS name, p_type AS description,
      CASE WHEN p_partkey % 13 = 0 THEN 'uncategorized' ELSE p_type END AS category,
      CASE WHEN p_partkey % 11 = 0 THEN 'unknown' ELSE p_brand END AS brand,
      CASE WHEN p_partkey % 17 = 0 THEN 0.0::DOUBLE ELSE p_retailprice END AS price,
      CASE WHEN p_partkey % 3 = 0 THEN {_r('p_retailprice * 1.1::DOUBLE', 2)}
           WHEN p_partkey % 17 = 0 THEN 0.0::DOUBLE ELSE p_retailprice END AS price_original,
      1.0::DOUBLE + (p_partkey % 41) / 10.0::DOUBLE AS rating, CAST(p_partkey % 200 AS INT) AS review_count,
      p_size % 3 <> 0 AS in_stock, CASE WHEN p_size % 5 <> 0 THEN p_size END AS stock_qty, 'FR' AS shop_country,
      CASE WHEN p_partkey % 4 = 1 THEN NULL ELSE CAST(date_diff('day', DATE '2020-01-01' + CAST(p_partkey % 365 AS INT),
           CAST(TIMESTAMP '{C.AS_OF}' AS DATE)) AS INT) END AS days_since_publish
      FROM part WHERE p_partkey % 59 <> 0)"""

DISCOUNT_PRE_SQL = f"""disc_base AS (SELECT *, {_r('abs(c_acctbal) / 10.0::DOUBLE + 1.0::DOUBLE', 2)} AS pr,
      CASE WHEN c_custkey % 4 = 0 THEN 0.0::DOUBLE ELSE CAST(c_custkey % 30 AS DOUBLE) + 0.5::DOUBLE END AS d FROM customer),
discount_pre AS (SELECT CAST(c_custkey AS VARCHAR) AS product_id, 'discount_api' AS source_platform, 'dummy_customers' AS source_store,
      c_name AS name, 'Segment ' || c_mktsegment AS description, lower(c_mktsegment) AS category,
      CASE WHEN c_custkey % 7 = 0 THEN 'unknown' ELSE 'Brand' || CAST(c_custkey % 9 AS VARCHAR) END AS brand,
      pr AS price, CASE WHEN d <> 0 THEN {_r('pr / (1.0::DOUBLE - d / 100.0::DOUBLE)', 2)} ELSE pr END AS price_original,
      {_r('1.0::DOUBLE + (c_custkey % 40) / 10.0::DOUBLE', 1)} AS rating, CAST(c_custkey % 4 AS INT) AS review_count,
      c_custkey % 50 > 0 AS in_stock, CAST(c_custkey % 50 AS INT) AS stock_qty, 'unknown' AS shop_country,
      CAST(NULL AS INT) AS days_since_publish FROM disc_base)"""

SIMPLE_PRE_SQL = f"""simple_pre AS (SELECT CAST(s_suppkey AS VARCHAR) AS product_id, 'simple_api' AS source_platform, 'fake_suppliers' AS source_store,
      s_name AS name, 'Supplier offer' AS description, 'cat' || CAST(s_nationkey % 4 AS VARCHAR) AS category, 'unknown' AS brand,
      {_r('abs(s_acctbal) / 100.0::DOUBLE + 1.0::DOUBLE', 2)} AS price, {_r('abs(s_acctbal) / 100.0::DOUBLE + 1.0::DOUBLE', 2)} AS price_original,
      CASE WHEN s_suppkey % 9 <> 0 THEN {_r('1.0::DOUBLE + (s_suppkey % 40) / 10.0::DOUBLE', 1)} ELSE 0.0::DOUBLE END AS rating,
      CAST(CASE WHEN s_suppkey % 9 <> 0 THEN s_suppkey % 300 ELSE 0 END AS INT) AS review_count, TRUE AS in_stock,
      CAST(NULL AS INT) AS stock_qty, 'unknown' AS shop_country, CAST(NULL AS INT) AS days_since_publish FROM supplier)"""


def _defaults_sql(src: str) -> str:
    po = "coalesce(nullif(price_original, 0), price)"
    return f"""SELECT product_id, source_platform, source_store, name, description, category, brand, price, {po} AS price_original,
  CASE WHEN {po} > price THEN ({po} - price) / {po} * 100.0::DOUBLE ELSE 0.0::DOUBLE END AS discount_pct,
  rating, review_count, in_stock, stock_qty, shop_country, days_since_publish,
  (CASE WHEN {po} > price THEN ({po} - price) / {po} * 100.0::DOUBLE ELSE 0.0::DOUBLE END) > 0 AS is_on_promo,
  CASE WHEN price < 30 THEN 'low' WHEN price < 100 THEN 'mid' ELSE 'high' END AS price_segment FROM {src}"""


def _landed(spark, sf, platform):
    return PL.parsed(spark, PL.land(spark, sf, platform), platform)


@query("shopify_products", f"WITH {SHOPIFY_PRE_SQL}\n{_defaults_sql('shopify_pre')}")
def q_shopify_products(spark: SparkSession, sf: str) -> DataFrame:
    """Shop payload -> product rows: first variant's prices, any-available stock, empty-variant skip."""
    return product_defaults(PL.shopify_products(_landed(spark, sf, "shopify"))).select(*PRODUCT_CONTRACT)


@query("shopify_variants", f"""SELECT CAST(o.o_orderkey AS VARCHAR) AS product_id, CAST(l.l_orderkey * 10 + l.l_linenumber AS VARCHAR) AS variant_id,
  'SKU-' || CAST(l.l_partkey AS VARCHAR) AS sku, CASE WHEN l.l_linenumber % 3 <> 0 THEN 'Size ' || CAST(l.l_linenumber AS VARCHAR) ELSE 'Default' END AS option_value,
  {_r('l.l_extendedprice / l.l_quantity', 2)} AS price, coalesce(CASE WHEN l.l_linestatus = 'O' THEN TRUE WHEN l.l_returnflag = 'A' THEN NULL ELSE FALSE END, TRUE) AS available,
  CAST(l.l_linenumber AS INT) AS position
FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey
WHERE o.o_orderkey % 101 <> 0 AND o.o_orderkey % 53 <> 0 AND o.o_orderkey % 31 <> 0""")
def q_shopify_variants(spark: SparkSession, sf: str) -> DataFrame:
    return PL.shopify_variants(_landed(spark, sf, "shopify")).select(*VARIANT_CONTRACT)


@query("woo_products", f"WITH {WOO_PRE_SQL}\n{_defaults_sql('woo_pre')}")
def q_woo_products(spark: SparkSession, sf: str) -> DataFrame:
    return product_defaults(PL.woo_products(_landed(spark, sf, "woocommerce"))).select(*PRODUCT_CONTRACT)


@query("woo_variants", """SELECT CAST(p_partkey AS VARCHAR) AS product_id, CAST(p_partkey * 10 + i AS VARCHAR) AS variant_id,
  'W-' || CAST(p_partkey AS VARCHAR) || '-' || CAST(i AS VARCHAR) AS sku,
  'Size:' || ['S', 'M', 'L'][i] || ', Color:c' || CAST(p_size % 4 AS VARCHAR) AS option_value,
  p_retailprice + i AS price, i % 2 <> 0 AS available, CAST(i AS INT) AS position
FROM (SELECT *, unnest(range(1, 2 + p_size % 3)) AS i FROM part WHERE p_partkey % 59 <> 0 AND p_size % 2 = 0) t""")
def q_woo_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Variations of 'variable' products; option text 'name:option, ...'."""
    return PL.woo_variants(_landed(spark, sf, "woocommerce")).select(*VARIANT_CONTRACT)


@query("discount_api_products", f"WITH {DISCOUNT_PRE_SQL}\n{_defaults_sql('discount_pre')}")
def q_discount_api_products(spark: SparkSession, sf: str) -> DataFrame:
    return product_defaults(PL.discount_api_products(_landed(spark, sf, "discount_api"))).select(*PRODUCT_CONTRACT)


@query("simple_api_products", f"WITH {SIMPLE_PRE_SQL}\n{_defaults_sql('simple_pre')}")
def q_simple_api_products(spark: SparkSession, sf: str) -> DataFrame:
    return product_defaults(PL.simple_api_products(_landed(spark, sf, "simple_api"))).select(*PRODUCT_CONTRACT)


ALL_PRE = f"WITH {SHOPIFY_PRE_SQL},\n{WOO_PRE_SQL},\n{DISCOUNT_PRE_SQL},\n{SIMPLE_PRE_SQL},\n" \
          "all_pre AS (SELECT * FROM shopify_pre UNION ALL SELECT * FROM woo_pre UNION ALL SELECT * FROM discount_pre " \
          "UNION ALL SELECT * FROM simple_pre)\n"


def all_sources(spark: SparkSession, sf: str):
    parsed = {pf: _landed(spark, sf, pf) for pf in PL.BUILDERS}
    products = {
        "shopify": PL.shopify_products(parsed["shopify"]), "woocommerce": PL.woo_products(parsed["woocommerce"]),
        "discount_api": PL.discount_api_products(parsed["discount_api"]),
        "simple_api": PL.simple_api_products(parsed["simple_api"]),
    }
    variants = {
        "shopify": PL.shopify_variants(parsed["shopify"]), "woocommerce": PL.woo_variants(parsed["woocommerce"]),
        "discount_api": PL.single_variants(products["discount_api"], parsed["discount_api"], "sku"),
        "simple_api": PL.single_variants(products["simple_api"], parsed["simple_api"], None),
    }
    return parsed, products, variants


@query("product_defaults", ALL_PRE + _defaults_sql("all_pre"))
def q_product_defaults(spark: SparkSession, sf: str) -> DataFrame:
    """All four sources unioned, with the ingest-time derived fields."""
    _, products, _ = all_sources(spark, sf)
    u = None
    for df in products.values():
        u = df if u is None else u.unionByName(df)
    return product_defaults(u).select(*PRODUCT_CONTRACT)


@query("bad_record_quarantine", """SELECT 'shopify' AS source_platform, 'malformed' AS reason, count(*) AS n FROM orders WHERE o_orderkey % 101 = 0
UNION ALL SELECT 'shopify', 'missing id', count(*) FROM orders WHERE o_orderkey % 53 = 0 AND o_orderkey % 101 <> 0
UNION ALL SELECT 'woocommerce', 'missing id', count(*) FROM part WHERE p_partkey % 59 = 0""")
def q_bad_record_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """Payload lines that fail to parse or carry no id go to a quarantine table (counted here)."""
    parsed, _, _ = all_sources(spark, sf)
    q = None
    for pf, pp in parsed.items():
        part = PL.quarantine(pp, pf)
        q = part if q is None else q.unionByName(part)
    return q.groupBy("source_platform", "reason").agg(F.count(F.lit(1)).alias("n"))


def ingest_log(products: dict, variants: dict) -> DataFrame:
    rows = None
    for pf, df in products.items():
        n_p = df.agg(F.count(F.lit(1)).alias("n_products"))
        n_v = variants[pf].agg(F.count(F.lit(1)).alias("n_variants"))
        r = n_p.select(F.lit(pf).alias("source"), "n_products", n_v.select("n_variants").scalar().alias("n_variants"))
        rows = r if rows is None else rows.unionByName(r)
    return rows.withColumn("success", F.col("n_products") > 0)


def ingest_summary(log: DataFrame) -> DataFrame:
    return log.agg(F.count(F.lit(1)).alias("total_sources"), F.count_if("success").alias("successful_sources"),
                   F.count_if(~F.col("success")).alias("failed_sources"),
                   F.sum(F.when(F.col("success"), F.col("n_products")).otherwise(0)).alias("total_products"),
                   F.sum(F.when(F.col("success"), F.col("n_variants")).otherwise(0)).alias("total_variants"))


@query("ingest_summary", f"""{ALL_PRE.rstrip()},
vcount AS (SELECT (SELECT count(*) FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey
                   WHERE o.o_orderkey % 101 <> 0 AND o.o_orderkey % 53 <> 0 AND o.o_orderkey % 31 <> 0)
                + (SELECT sum(1 + p_size % 3) FROM part WHERE p_partkey % 59 <> 0 AND p_size % 2 = 0)
                + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS n)
SELECT 4 AS total_sources, 4 AS successful_sources, 0 AS failed_sources, (SELECT count(*) FROM all_pre) AS total_products,
       CAST((SELECT n FROM vcount) AS BIGINT) AS total_variants""")
def q_ingest_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Sources ok / failed and product and variant totals over the per-source ingest log."""
    _, products, variants = all_sources(spark, sf)
    return ingest_summary(ingest_log(products, variants))
