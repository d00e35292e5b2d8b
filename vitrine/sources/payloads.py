"""Landed shop payloads (JSON lines) and their mapping to product / variant rows (section 2.2).

The network fetch is not built; payload files are landed from the shared tables so that the mapping
jobs read real JSON text whose size grows with the data:

- shopify:      one product per order, its line items as variants (at most 7 per order)
- woocommerce:  one product per part, variations for "variable" products
- discount API: one product per customer row, with a reviews array
- simple API:   one product per supplier row, with a nested rating object

Each mapping is ``from_json`` with an explicit schema (PERMISSIVE: a malformed line parses to null and
goes to the quarantine table with a missing id), struct access and higher-order functions; nothing
runs row by row in Python.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions import numeric as N
from ..functions import text as T
from ..session import tables_root
from .tables import read_table

R = N.round_half_up

# Source names used for the landed fixtures (store, platform, country).
SOURCES = {
    "shopify": ("shop_orders", "US"),
    "woocommerce": ("woo_parts", "FR"),
    "discount_api": ("dummy_customers", "unknown"),
    "simple_api": ("fake_suppliers", "unknown"),
}

SHOPIFY_SCHEMA = ("id long, title string, body_html string, product_type string, vendor string, published_at string, "
                  "variants array<struct<position int, id long, sku string, title string, price string, "
                  "compare_at_price string, available boolean>>")
WOO_SCHEMA = ("id long, name string, description string, price string, regular_price string, date_created string, "
              "average_rating string, rating_count int, stock_status string, stock_quantity int, type string, "
              "categories array<struct<name string>>, brand string, variations array<struct<id long, sku string, "
              "price string, stock_status string, attributes array<struct<name string, option string>>>>")
DISCOUNT_SCHEMA = ("id long, title string, description string, category string, brand string, price double, "
                   "discountPercentage double, rating double, reviews array<struct<rating int>>, stock int, sku string")
SIMPLE_SCHEMA = "id long, title string, description string, category string, price double, rating struct<rate double, count int>"


def _date_text(key: F.Column, ts: F.Column) -> F.Column:
    """The four accepted layouts plus the rejected zoneless 'T' time, by key."""
    return (F.when(key % 4 == 0, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")))
            .when(key % 4 == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"))
            .when(key % 4 == 2, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
            .otherwise(F.date_format(ts, "yyyy-MM-dd")))


def shopify_payloads(spark: SparkSession, sf: str) -> DataFrame:
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    li = read_table(spark, sf, "lineitem")
    unit = R(F.col("l_extendedprice") / F.col("l_quantity"), 2)
    orig = R(F.col("l_extendedprice") / F.col("l_quantity") / (F.lit(1.0) - F.col("l_discount")), 2)
    variant = F.struct(
        F.col("l_linenumber").alias("position"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.concat(F.lit("SKU-"), F.col("l_partkey").cast("string")).alias("sku"),
        F.when(F.col("l_linenumber") % 3 != 0, F.concat(F.lit("Size "), F.col("l_linenumber").cast("string"))).alias("title"),
        unit.cast("string").alias("price"),
        F.when(F.col("l_discount") >= 0.05, orig.cast("string")).when(F.col("l_discount") == 0, F.lit("")).alias("compare_at_price"),
        F.when(F.col("l_linestatus") == "O", F.lit(True)).when(F.col("l_returnflag") == "A", F.lit(None))
         .otherwise(F.lit(False)).alias("available"),
    )
    # an order has at most 7 lines: the variant list per payload is bounded
    lines = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(variant)).alias("variants"))
    j = o.join(lines, o.o_orderkey == lines.l_orderkey, "left")
    k = F.col("o_orderkey")
    empty = F.array().cast("array<struct<position int, id long, sku string, title string, price string, "
                           "compare_at_price string, available boolean>>")
    doc = F.struct(
        F.when(k % 53 != 0, k).alias("id"),
        F.concat(F.lit("Order "), k.cast("string")).alias("title"),
        F.concat(F.lit("<p>"), F.col("o_orderpriority"), F.lit(" &amp; more</p>")).alias("body_html"),
        F.when(k % 7 != 0, F.col("o_orderpriority")).alias("product_type"),
        F.concat(F.lit("Vendor "), (F.col("o_custkey") % 50).cast("string")).alias("vendor"),
        _date_text(k, F.col("o_orderdate")).alias("published_at"),
        F.when(k % 31 == 0, empty).otherwise(F.coalesce(F.col("variants"), empty)).alias("variants"),
    )
    text = F.to_json(doc)
    # a few truncated (malformed) lines
    return j.select(F.when(k % 101 == 0, F.substring(text, 1, 20)).otherwise(text).alias("value"))


def woo_payloads(spark: SparkSession, sf: str) -> DataFrame:
    p = read_table(spark, sf, "part")
    k, size = F.col("p_partkey"), F.col("p_size")
    created = F.date_add(F.to_date(F.lit("2020-01-01")), (k % 365).cast("int")).cast("timestamp")
    variation = lambda i: F.struct(
        (k * 10 + i).alias("id"),
        F.concat(F.lit("W-"), k.cast("string"), F.lit("-"), i.cast("string")).alias("sku"),
        (F.col("p_retailprice") + i).cast("string").alias("price"),
        F.when(i % 2 == 0, F.lit("outofstock")).otherwise(F.lit("instock")).alias("stock_status"),
        F.array(F.struct(F.lit("Size").alias("name"), F.element_at(F.array(F.lit("S"), F.lit("M"), F.lit("L")), i.cast("int")).alias("option")),
                F.struct(F.lit("Color").alias("name"), F.concat(F.lit("c"), (size % 4).cast("string")).alias("option"))).alias("attributes"),
    )
    doc = F.struct(
        F.when(k % 59 != 0, k).alias("id"),
        F.col("p_name").alias("name"),
        F.concat(F.lit("<div>"), F.col("p_type"), F.lit("</div>")).alias("description"),
        F.when(k % 17 == 0, F.lit("")).otherwise(F.col("p_retailprice").cast("string")).alias("price"),
        F.when(k % 3 == 0, R(F.col("p_retailprice") * F.lit(1.1), 2).cast("string")).alias("regular_price"),
        _date_text(k, created).alias("date_created"),
        (F.lit(1.0) + (k % 41) / F.lit(10.0)).cast("string").alias("average_rating"),
        (k % 200).cast("int").alias("rating_count"),
        F.when(size % 3 == 0, F.lit("outofstock")).otherwise(F.lit("instock")).alias("stock_status"),
        F.when(size % 5 != 0, size).alias("stock_quantity"),
        F.when(size % 2 == 0, F.lit("variable")).otherwise(F.lit("simple")).alias("type"),
        F.when(k % 13 == 0, F.array().cast("array<struct<name string>>"))
         .otherwise(F.array(F.struct(F.col("p_type").alias("name")))).alias("categories"),
        F.when(k % 11 != 0, F.col("p_brand")).alias("brand"),
        F.when(size % 2 == 0, F.transform(F.sequence(F.lit(1), F.lit(1) + size % 3), variation)).alias("variations"),
    )
    return p.select(F.to_json(doc).alias("value"))


def discount_payloads(spark: SparkSession, sf: str) -> DataFrame:
    c = read_table(spark, sf, "customer")
    k = F.col("c_custkey")
    doc = F.struct(
        k.alias("id"), F.col("c_name").alias("title"),
        F.concat(F.lit("Segment "), F.col("c_mktsegment")).alias("description"),
        F.lower(F.col("c_mktsegment")).alias("category"),
        F.when(k % 7 != 0, F.concat(F.lit("Brand"), (k % 9).cast("string"))).alias("brand"),
        R(F.abs(F.col("c_acctbal")) / F.lit(10.0) + F.lit(1.0), 2).alias("price"),
        F.when(k % 4 == 0, F.lit(0.0)).otherwise((k % 30).cast("double") + F.lit(0.5)).alias("discountPercentage"),
        R(F.lit(1.0) + (k % 40) / F.lit(10.0), 1).alias("rating"),
        F.transform(F.slice(F.array(F.lit(1), F.lit(2), F.lit(3)), F.lit(1), (k % 4).cast("int")),
                    lambda i: F.struct((i % 5 + 1).cast("int").alias("rating"))).alias("reviews"),
        (k % 50).cast("int").alias("stock"),
        F.concat(F.lit("D-"), k.cast("string")).alias("sku"),
    )
    return c.select(F.to_json(doc).alias("value"))


def simple_payloads(spark: SparkSession, sf: str) -> DataFrame:
    s = read_table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    doc = F.struct(
        k.alias("id"), F.col("s_name").alias("title"), F.lit("Supplier offer").alias("description"),
        F.concat(F.lit("cat"), (F.col("s_nationkey") % 4).cast("string")).alias("category"),
        R(F.abs(F.col("s_acctbal")) / F.lit(100.0) + F.lit(1.0), 2).alias("price"),
        F.when(k % 9 != 0, F.struct(R(F.lit(1.0) + (k % 40) / F.lit(10.0), 1).alias("rate"),
                                    (k % 300).cast("int").alias("count"))).alias("rating"),
    )
    return s.select(F.to_json(doc).alias("value"))


BUILDERS = {"shopify": shopify_payloads, "woocommerce": woo_payloads, "discount_api": discount_payloads,
            "simple_api": simple_payloads}
SCHEMAS = {"shopify": SHOPIFY_SCHEMA, "woocommerce": WOO_SCHEMA, "discount_api": DISCOUNT_SCHEMA,
           "simple_api": SIMPLE_SCHEMA}


def land(spark: SparkSession, sf: str, platform: str) -> str:
    """Write the platform's payloads as JSON-lines files under the shared folder; return the folder."""
    path = f"{tables_root(spark)}/landing/{platform}-{uuid.uuid4().hex}"
    BUILDERS[platform](spark, sf).write.mode("overwrite").text(path)
    return path


def parsed(spark: SparkSession, path: str, platform: str) -> DataFrame:
    """Landed lines parsed with the platform schema (PERMISSIVE); a malformed line keeps its text in
    ``p._corrupt_record``."""
    raw = spark.read.text(path)
    schema = SCHEMAS[platform] + ", _corrupt_record string"
    opts = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    return raw.select(F.col("value").alias("_line"), F.from_json("value", schema, opts).alias("p"))


def _with_source(df: DataFrame, platform: str) -> DataFrame:
    store, country = SOURCES[platform]
    return df.withColumn("source_platform", F.lit(platform)).withColumn("source_store", F.lit(store)) \
             .withColumn("shop_country", F.lit(country))


def _malformed() -> F.Column:
    return F.col("p").isNull() | F.col("p._corrupt_record").isNotNull()


def valid(pp: DataFrame) -> DataFrame:
    return pp.filter(~_malformed() & F.col("p.id").isNotNull())


def quarantine(pp: DataFrame, platform: str) -> DataFrame:
    bad = pp.filter(_malformed() | F.col("p.id").isNull())
    reason = F.when(_malformed(), F.lit("malformed")).otherwise(F.lit("missing id"))
    return bad.select(F.lit(platform).alias("source_platform"), reason.alias("reason"), F.col("_line").alias("line"))


PRE_DEFAULT_COLS = ["product_id", "source_platform", "source_store", "name", "description", "category", "brand", "price",
                    "price_original", "rating", "review_count", "in_stock", "stock_qty", "shop_country",
                    "days_since_publish"]


def shopify_products(pp: DataFrame, as_of: str = C.AS_OF) -> DataFrame:
    v = valid(pp).filter(F.size("p.variants") > 0)
    first = F.element_at(F.col("p.variants"), 1)
    price = F.coalesce(first["price"].try_cast("double"), F.lit(0.0))
    cmp_ = first["compare_at_price"]
    original = F.when(cmp_.isNull() | (cmp_ == ""), price).otherwise(cmp_.try_cast("double"))
    out = v.select(
        F.col("p.id").cast("string").alias("product_id"),
        F.coalesce(F.col("p.title"), F.lit("")).alias("name"),
        T.clean_html(F.col("p.body_html")).alias("description"),
        F.coalesce(F.col("p.product_type"), F.lit("uncategorized")).alias("category"),
        F.coalesce(F.col("p.vendor"), F.lit("unknown")).alias("brand"),
        price.alias("price"), original.alias("price_original"),
        F.lit(None).cast("double").alias("rating"), F.lit(None).cast("int").alias("review_count"),
        F.exists("p.variants", lambda x: F.coalesce(x["available"], F.lit(False))).alias("in_stock"),
        F.lit(None).cast("int").alias("stock_qty"),
        N.days_since(F.col("p.published_at"), as_of).alias("days_since_publish"),
    )
    return _with_source(out, "shopify").select(*PRE_DEFAULT_COLS)


def shopify_variants(pp: DataFrame) -> DataFrame:
    v = valid(pp).select(F.col("p.id").cast("string").alias("product_id"), F.posexplode("p.variants").alias("i", "v"))
    return v.select(
        "product_id", F.col("v.id").cast("string").alias("variant_id"), F.coalesce(F.col("v.sku"), F.lit("")).alias("sku"),
        F.coalesce(F.col("v.title"), F.lit("Default")).alias("option_value"),
        F.coalesce(F.col("v.price").try_cast("double"), F.lit(0.0)).alias("price"),
        F.coalesce(F.col("v.available"), F.lit(True)).alias("available"),
        F.coalesce(F.col("v.position"), F.col("i") + 1).cast("int").alias("position"))


def woo_products(pp: DataFrame, as_of: str = C.AS_OF) -> DataFrame:
    v = valid(pp)
    price = F.coalesce(F.when(F.col("p.price") != "", F.col("p.price").try_cast("double")), F.lit(0.0))
    reg = F.col("p.regular_price")
    original = F.when(reg.isNull() | (reg == ""), price).otherwise(reg.try_cast("double"))
    out = v.select(
        F.col("p.id").cast("string").alias("product_id"),
        F.coalesce(F.col("p.name"), F.lit("")).alias("name"),
        T.clean_html(F.col("p.description")).alias("description"),
        F.coalesce(F.try_element_at(F.col("p.categories"), F.lit(1))["name"], F.lit("uncategorized")).alias("category"),
        F.coalesce(F.col("p.brand"), F.lit("unknown")).alias("brand"),
        price.alias("price"), original.alias("price_original"),
        F.col("p.average_rating").try_cast("double").alias("rating"), F.col("p.rating_count").alias("review_count"),
        (F.coalesce(F.col("p.stock_status"), F.lit("")) == "instock").alias("in_stock"),
        F.col("p.stock_quantity").alias("stock_qty"),
        N.days_since(F.col("p.date_created"), as_of).alias("days_since_publish"),
    )
    return _with_source(out, "woocommerce").select(*PRE_DEFAULT_COLS)


def woo_variants(pp: DataFrame) -> DataFrame:
    v = valid(pp).filter(F.col("p.type") == "variable") \
        .select(F.col("p.id").cast("string").alias("product_id"), F.posexplode("p.variations").alias("i", "v"))
    opts = F.array_join(F.transform("v.attributes", lambda a: F.concat_ws(":", a["name"], a["option"])), ", ")
    return v.select(
        "product_id", F.col("v.id").cast("string").alias("variant_id"), F.coalesce(F.col("v.sku"), F.lit("")).alias("sku"),
        opts.alias("option_value"),
        F.coalesce(F.when(F.col("v.price") != "", F.col("v.price").try_cast("double")), F.lit(0.0)).alias("price"),
        (F.coalesce(F.col("v.stock_status"), F.lit("")) == "instock").alias("available"),
        (F.col("i") + 1).cast("int").alias("position"))


def discount_api_products(pp: DataFrame) -> DataFrame:
    v = valid(pp)
    price = F.coalesce(F.col("p.price"), F.lit(0.0))
    d = F.coalesce(F.col("p.discountPercentage"), F.lit(0.0))
    original = F.when(d != 0, R(price / (F.lit(1.0) - d / F.lit(100.0)), 2)).otherwise(price)
    stock = F.coalesce(F.col("p.stock"), F.lit(0))
    out = v.select(
        F.col("p.id").cast("string").alias("product_id"), F.coalesce(F.col("p.title"), F.lit("")).alias("name"),
        T.clean_html(F.col("p.description")).alias("description"),
        F.coalesce(F.col("p.category"), F.lit("uncategorized")).alias("category"),
        F.coalesce(F.col("p.brand"), F.lit("unknown")).alias("brand"),
        price.alias("price"), original.alias("price_original"),
        F.coalesce(F.col("p.rating"), F.lit(0.0)).alias("rating"),
        F.coalesce(F.size("p.reviews"), F.lit(0)).cast("int").alias("review_count"),
        (stock > 0).alias("in_stock"), stock.cast("int").alias("stock_qty"),
        F.lit(None).cast("int").alias("days_since_publish"),
    )
    return _with_source(out, "discount_api").select(*PRE_DEFAULT_COLS)


def simple_api_products(pp: DataFrame) -> DataFrame:
    v = valid(pp)
    price = F.coalesce(F.col("p.price"), F.lit(0.0))
    out = v.select(
        F.col("p.id").cast("string").alias("product_id"), F.coalesce(F.col("p.title"), F.lit("")).alias("name"),
        T.clean_html(F.col("p.description")).alias("description"),
        F.coalesce(F.col("p.category"), F.lit("uncategorized")).alias("category"),
        F.lit("unknown").alias("brand"), price.alias("price"), price.alias("price_original"),
        F.coalesce(F.col("p.rating.rate"), F.lit(0.0)).alias("rating"),
        F.coalesce(F.col("p.rating.count"), F.lit(0)).cast("int").alias("review_count"),
        F.lit(True).alias("in_stock"), F.lit(None).cast("int").alias("stock_qty"),
        F.lit(None).cast("int").alias("days_since_publish"),
    )
    return _with_source(out, "simple_api").select(*PRE_DEFAULT_COLS)


def single_variants(products: DataFrame, pp: DataFrame, sku_field: str | None) -> DataFrame:
    """One default variant per product (the two API sources)."""
    sku = F.coalesce(F.col(f"p.{sku_field}"), F.lit("")) if sku_field else F.lit("")
    skus = valid(pp).select(F.col("p.id").cast("string").alias("product_id"), sku.alias("sku"))
    return products.join(skus, "product_id").select(
        "product_id", F.concat(F.col("product_id"), F.lit("-1")).alias("variant_id"), "sku",
        F.lit("Default").alias("option_value"), "price", F.col("in_stock").alias("available"),
        F.lit(1).alias("position"))
