"""Dashboard and report aggregates over the processed catalog (sections 2.3, 2.4, 2.5, 2.7, 2.8).

Each aggregate is a single grouped pass (partial aggregation before the shuffle); top-n results use
``orderBy().limit()`` (TakeOrderedAndProject: k rows per task reach the final merge); shares use a
window over the *grouped* result, never over raw rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions.rand import hash_order_key
from ..oracle.catalog import rnd, with_products, with_products_ctes, with_raw_ctes
from ..operators.dedup import distinct_values
from ..operators.quantiles import exact_quantiles
from ..registry import query
from ..sources.adapters import RAW_VARIANTS_SQL, raw_variants
from .landing import landed_cte, landed_products
from ..session import cached_layer, materialize, new_table
from ..sources.searchindex import SearchIndex
from ..sources.tables import read_table, table_path
from .preprocess import RAW_INPUTS, processed_products
from .preprocess_queries import TOPK_SQL, topk_products

R = N.round_half_up


def pct(col) -> F.Column:
    return R(F.avg(F.col(col).cast("double")) * F.lit(100.0), 1)


def kpis(products: DataFrame, metrics: DataFrame | None = None, approx_distinct: bool = False) -> DataFrame:
    """Headline numbers; optional one-row model-metric table is attached as extra columns.
    ``approx_distinct`` counts categories / brands / sources with HyperLogLog++ sketches instead."""
    sketched = [("category", "n_categories"), ("brand", "n_brands"), ("source_store", "n_sources")]
    out = products.agg(
        F.count(F.lit(1)).alias("total_products"),
        F.sum("topk_label").cast("long").alias("topk_count"),
        pct("topk_label").alias("topk_pct"),
        R(F.avg("rating"), 2).alias("avg_rating"),
        R(F.avg("price"), 2).alias("avg_price"),
        pct("in_stock").alias("in_stock_pct"),
        pct("is_on_promo").alias("on_promo_pct"),
        *[F.approx_count_distinct(c).alias(n) for c, n in sketched if approx_distinct],
    )
    if not approx_distinct:
        out = out.select("*", *[distinct_values(products, c).alias(n) for c, n in sketched])
    if metrics is not None:
        for c in metrics.columns:
            out = out.withColumn(c, metrics.select(c).scalar())
    return out


def _pct_sql(c):
    return rnd(f"avg(CAST({c} AS DOUBLE)) * 100.0::DOUBLE", 1)


KPIS_SELECT = f"""SELECT count(*) AS total_products, CAST(sum(topk_label) AS BIGINT) AS topk_count,
  {_pct_sql('topk_label')} AS topk_pct, {rnd('avg(rating)', 2)} AS avg_rating, {rnd('avg(price)', 2)} AS avg_price,
  {_pct_sql('in_stock')} AS in_stock_pct, {_pct_sql('is_on_promo')} AS on_promo_pct,
  count(DISTINCT category) AS n_categories, count(DISTINCT brand) AS n_brands,
  count(DISTINCT source_store) AS n_sources FROM products"""
KPIS_SQL = with_products(KPIS_SELECT)


@query("kpis", KPIS_SQL)
def q_kpis(spark: SparkSession, sf: str) -> DataFrame:
    return kpis(processed_products(spark, sf))


def brand_topk_rate(products: DataFrame, min_count: int = 10, n: int = 20) -> DataFrame:
    g = products.groupBy("brand").agg(F.count(F.lit(1)).alias("count"),
                                      F.avg(F.col("topk_label").cast("double")).alias("topk_rate"),
                                      F.avg("price").alias("avg_price"))
    g = g.filter(F.col("count") >= min_count)
    top = g.orderBy(F.col("topk_rate").desc(), F.col("brand").asc()).limit(n)
    return top.select("brand", "count", R(F.col("topk_rate") * F.lit(100.0), 1).alias("topk_pct"),
                      R(F.col("avg_price"), 2).alias("avg_price"))


@query("brand_topk_rate", with_products(f"""SELECT brand, count, {rnd('topk_rate * 100.0::DOUBLE', 1)} AS topk_pct,
  {rnd('avg_price', 2)} AS avg_price FROM (SELECT brand, count(*) AS count, avg(CAST(topk_label AS DOUBLE)) AS topk_rate,
  avg(price) AS avg_price FROM products GROUP BY brand HAVING count(*) >= 10) g
  ORDER BY topk_rate DESC, brand LIMIT 20"""))
def q_brand_topk_rate(spark: SparkSession, sf: str) -> DataFrame:
    return brand_topk_rate(processed_products(spark, sf))


def store_performance(products: DataFrame) -> DataFrame:
    g = products.groupBy("source_store").agg(
        F.count(F.lit(1)).alias("products"), F.sum("topk_label").cast("long").alias("topk_count"),
        R(F.avg(F.col("topk_label").cast("double")), 3).alias("_tr"), R(F.avg("price"), 3).alias("avg_price"),
        R(F.avg("rating"), 3).alias("avg_rating"), R(F.avg(F.col("in_stock").cast("double")), 3).alias("_is"))
    return g.select("source_store", "products", "topk_count", R(F.col("_tr") * F.lit(100.0), 1).alias("topk_rate_pct"),
                    "avg_price", "avg_rating", R(F.col("_is") * F.lit(100.0), 1).alias("in_stock_pct"))


@query("store_performance", with_products(f"""SELECT source_store, products, topk_count,
  {rnd('tr * 100.0::DOUBLE', 1)} AS topk_rate_pct, avg_price, avg_rating, {rnd('ist * 100.0::DOUBLE', 1)} AS in_stock_pct
  FROM (SELECT source_store, count(*) AS products, CAST(sum(topk_label) AS BIGINT) AS topk_count,
        {rnd('avg(CAST(topk_label AS DOUBLE))', 3)} AS tr, {rnd('avg(price)', 3)} AS avg_price,
        {rnd('avg(rating)', 3)} AS avg_rating, {rnd('avg(CAST(in_stock AS DOUBLE))', 3)} AS ist
        FROM products GROUP BY source_store) g"""))
def q_store_performance(spark: SparkSession, sf: str) -> DataFrame:
    return store_performance(processed_products(spark, sf))


def stock_status(products: DataFrame) -> DataFrame:
    g = products.groupBy("source_store", "in_stock").agg(F.count(F.lit(1)).alias("count"))
    return g.withColumn("status", F.when(F.col("in_stock"), "In Stock").otherwise("Out of Stock"))


@query("stock_status", with_products("""SELECT source_store, in_stock, count(*) AS count,
  CASE WHEN in_stock THEN 'In Stock' ELSE 'Out of Stock' END AS status FROM products GROUP BY source_store, in_stock"""))
def q_stock_status(spark: SparkSession, sf: str) -> DataFrame:
    return stock_status(processed_products(spark, sf))


def value_counts(df: DataFrame, col: str, n: int | None = None) -> DataFrame:
    """Count per value, descending, with its share in %, optionally the first ``n`` (ties by value)."""
    g = df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    total = df.select(F.count(F.lit(1))).scalar()
    g = g.withColumn("share_pct", R(F.col("count") / total * F.lit(100.0), 1))
    if n is not None:
        g = g.orderBy(F.col("count").desc(), F.col(col).asc()).limit(n)
    return g


@query("value_counts", with_products(f"""SELECT category, count(*) AS count,
  {rnd('count(*) / sum(count(*)) OVER () * 100.0::DOUBLE', 1)} AS share_pct FROM products GROUP BY category"""))
def q_value_counts(spark: SparkSession, sf: str) -> DataFrame:
    return value_counts(processed_products(spark, sf), "category")


@query("topk_category_breakdown", with_products_ctes(f"""topk AS ({TOPK_SQL})
SELECT category, count(*) AS count FROM topk GROUP BY category ORDER BY count DESC, category LIMIT 15"""))
def q_topk_category_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    t = topk_products(processed_products(spark, sf))
    return t.groupBy("category").agg(F.count(F.lit(1)).alias("count")) \
            .orderBy(F.col("count").desc(), F.col("category").asc()).limit(15)


STORES_FILTER = ["store_0", "store_1", "store_2", "store_3", "store_5", "store_6"]
SEGMENTS_FILTER = ["low", "mid"]


def _in_list(values):
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def filtered_kpi_strip(topk: DataFrame) -> DataFrame:
    return topk.agg(F.count(F.lit(1)).alias("shown"), R(F.avg("price"), 2).alias("avg_price"),
                    R(F.avg("rating"), 2).alias("avg_rating"), R(F.avg("review_count"), 0).alias("avg_reviews"),
                    pct("is_on_promo").alias("on_promo_pct"))


@query("filtered_kpi_strip", with_products_ctes(f"""topk AS ({TOPK_SQL})
SELECT count(*) AS shown, {rnd('avg(price)', 2)} AS avg_price, {rnd('avg(rating)', 2)} AS avg_rating,
  {rnd('avg(review_count)', 0)} AS avg_reviews, {_pct_sql('is_on_promo')} AS on_promo_pct
FROM topk WHERE source_store IN {_in_list(STORES_FILTER)}"""))
def q_filtered_kpi_strip(spark: SparkSession, sf: str) -> DataFrame:
    t = topk_products(processed_products(spark, sf)).filter(F.col("source_store").isin(STORES_FILTER))
    return filtered_kpi_strip(t)


@query("multiselect_filter", with_products_ctes(f"""topk AS ({TOPK_SQL})
SELECT rank, product_id, source_store, price_segment, popularity_score FROM topk
WHERE source_store IN {_in_list(STORES_FILTER)} AND price_segment IN {_in_list(SEGMENTS_FILTER)}"""))
def q_multiselect_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Top-k rows whose store is in one selection and segment in another (``isin`` lists)."""
    t = topk_products(processed_products(spark, sf))
    t = t.filter(F.col("source_store").isin(STORES_FILTER) & F.col("price_segment").isin(SEGMENTS_FILTER))
    return t.select("rank", "product_id", "source_store", "price_segment", "popularity_score")


def product_index(spark: SparkSession, sf: str) -> SearchIndex:
    """Posting lists of the processed products' names, brands and ids, written with the layer."""
    inputs = [table_path(sf, t) for t in RAW_INPUTS]
    return cached_layer(spark, "product_index", inputs, "processed", lambda: SearchIndex.build(
        processed_products(spark, sf), new_table(spark, "product-index"), ["name", "brand"], ["product_id"]))


SEARCH_TERM = "Bolt"


@query("text_search", with_products(f"""SELECT product_id, source_store, name, brand FROM products
WHERE coalesce(contains(lower(name), '{SEARCH_TERM.lower()}'), FALSE)
   OR coalesce(contains(lower(brand), '{SEARCH_TERM.lower()}'), FALSE)"""))
def q_text_search(spark: SparkSession, sf: str) -> DataFrame:
    """Case-insensitive substring search in name or brand, by posting lists."""
    return product_index(spark, sf).search(SEARCH_TERM).select("product_id", "source_store", "name", "brand")


LOOKUP_COLS = ["name", "description", "category", "brand", "price", "discount_pct", "rating", "review_count",
               "in_stock", "stock_qty", "source_store", "popularity_score"]


def product_lookup(products: DataFrame, product_id) -> DataFrame:
    """Selected columns of one product (all stores carrying it), plus the row as JSON text."""
    rows = products.filter(F.col("product_id") == product_id).select("product_id", *LOOKUP_COLS)
    return rows.withColumn("json", F.to_json(F.struct(*LOOKUP_COLS)))


@query("product_lookup", with_products_ctes(f"""first_id AS (SELECT min(product_id) AS pid FROM products)
SELECT product_id, {', '.join(LOOKUP_COLS)} FROM products WHERE product_id = (SELECT pid FROM first_id)"""))
def q_product_lookup(spark: SparkSession, sf: str) -> DataFrame:
    pid = processed_products(spark, sf).agg(F.min("product_id")).first()[0]
    return product_lookup(product_index(spark, sf).lookup("product_id", pid), F.lit(pid)).drop("json")


def histogram(df: DataFrame, col: str, bins: int, by: str | None = None) -> DataFrame:
    """Equal-width bins between the column's min and max (one scalar pass, then one grouped pass)."""
    # one scalar subquery (one pass) for both ends
    mm = df.select(F.struct(F.min(col).alias("lo"), F.max(col).alias("hi"))).scalar()
    lo, hi = mm.getField("lo"), mm.getField("hi")
    width = (hi - lo) / F.lit(float(bins))
    b = F.when(hi == lo, F.lit(0)).otherwise(
        F.least(F.floor((F.col(col) - lo) / width), F.lit(bins - 1))).cast("int")
    keys = [b.alias("bin")] + ([F.col(by)] if by else [])
    g = df.filter(F.col(col).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
    return g.select("bin", *([by] if by else []),
                    R(lo + F.col("bin") * width, 4).alias("bin_lo"),
                    R(lo + (F.col("bin") + 1) * width, 4).alias("bin_hi"), "count")


def _hist_sql(col: str, bins: int, by: str | None = None) -> str:
    byc = f", {by}" if by else ""
    return with_products_ctes(f"""mm AS (SELECT min({col}) AS lo, max({col}) AS hi FROM products),
b AS (SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor(({col} - lo) / ((hi - lo) / {float(bins)}::DOUBLE)), {bins - 1}) END AS INT)
      AS bin{byc}, lo, hi FROM products CROSS JOIN mm WHERE {col} IS NOT NULL)
SELECT bin{byc}, {rnd(f'lo + bin * ((hi - lo) / {float(bins)}::DOUBLE)', 4)} AS bin_lo,
       {rnd(f'lo + (bin + 1) * ((hi - lo) / {float(bins)}::DOUBLE)', 4)} AS bin_hi, count(*) AS count
FROM b GROUP BY bin{byc}, lo, hi""")


@query("histogram", _hist_sql("popularity_score", 40))
def q_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Popularity score in 40 equal-width bins."""
    return histogram(processed_products(spark, sf), "popularity_score", 40)


@query("histogram_rating", _hist_sql("rating", 30))
def q_histogram_rating(spark: SparkSession, sf: str) -> DataFrame:
    return histogram(processed_products(spark, sf), "rating", 30)


@query("histogram_price_by_label", _hist_sql("price", 40, "topk_label"))
def q_histogram_price_by_label(spark: SparkSession, sf: str) -> DataFrame:
    return histogram(processed_products(spark, sf), "price", 40, by="topk_label")


def box_stats(df: DataFrame, value: str, by: str) -> DataFrame:
    """Quartiles, whiskers (furthest points within 1.5 IQR) and outlier count per group."""
    n = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    q = n.join(exact_quantiles(df, value, [0.25, 0.5, 0.75], [by], "_q"), by)
    q = q.select(by, "n", F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3"))
    q = q.withColumn("iqr", F.col("q3") - F.col("q1"))
    # one row per group (three price segments): a bounded broadcast, so no group is a hot join key
    j = df.select(by, value).join(F.broadcast(q), by)
    lo_f = F.col("q1") - F.lit(1.5) * F.col("iqr")
    hi_f = F.col("q3") + F.lit(1.5) * F.col("iqr")
    inside = (F.col(value) >= lo_f) & (F.col(value) <= hi_f)
    w = j.groupBy(by).agg(F.min(F.when(inside, F.col(value))).alias("whisker_lo"),
                          F.max(F.when(inside, F.col(value))).alias("whisker_hi"),
                          F.count_if(~inside).alias("n_outliers"))
    out = q.join(w, by)
    return out.select(by, "n", *[R(F.col(c), 4).alias(c) for c in ["q1", "median", "q3", "iqr"]],
                      "whisker_lo", "whisker_hi", "n_outliers")


@query("box_stats", with_products_ctes(f"""promo AS (SELECT price_segment, discount_pct FROM products WHERE discount_pct > 0),
q AS (SELECT price_segment, count(*) AS n, quantile_cont(discount_pct, 0.25) AS q1, quantile_cont(discount_pct, 0.5) AS median,
      quantile_cont(discount_pct, 0.75) AS q3 FROM promo GROUP BY price_segment),
w AS (SELECT q.price_segment,
      min(CASE WHEN discount_pct >= q1 - 1.5::DOUBLE * (q3 - q1) AND discount_pct <= q3 + 1.5::DOUBLE * (q3 - q1) THEN discount_pct END) AS whisker_lo,
      max(CASE WHEN discount_pct >= q1 - 1.5::DOUBLE * (q3 - q1) AND discount_pct <= q3 + 1.5::DOUBLE * (q3 - q1) THEN discount_pct END) AS whisker_hi,
      count(*) FILTER (WHERE NOT (discount_pct >= q1 - 1.5::DOUBLE * (q3 - q1) AND discount_pct <= q3 + 1.5::DOUBLE * (q3 - q1))) AS n_outliers
      FROM promo JOIN q ON promo.price_segment = q.price_segment GROUP BY q.price_segment)
SELECT q.price_segment, n, {rnd('q1', 4)} AS q1, {rnd('median', 4)} AS median, {rnd('q3', 4)} AS q3,
       {rnd('q3 - q1', 4)} AS iqr, whisker_lo, whisker_hi, n_outliers FROM q JOIN w ON q.price_segment = w.price_segment"""))
def q_box_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Discount distribution per price segment, promo rows only."""
    p = processed_products(spark, sf).filter(F.col("discount_pct") > 0)
    return box_stats(p, "discount_pct", "price_segment")


@query("store_item_sets", with_products("""SELECT source_platform, source_store, list_sort(list(DISTINCT category)) AS items,
  count(DISTINCT category) AS n_items FROM products GROUP BY source_platform, source_store"""))
def q_store_item_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct categories per (platform, store), sorted: the store-level baskets."""
    # rows collapse to distinct categories by hash, so no list is built, and no row sorted, per product
    p = processed_products(spark, sf).select("source_platform", "source_store", "category").distinct()
    return p.groupBy("source_platform", "source_store").agg(
        F.array_sort(F.collect_list("category")).alias("items"), F.count("category").alias("n_items"))


SAMPLE_N = 1000
SAMPLE_SEED = 42


def sample_n(df: DataFrame, key: F.Column, n: int = SAMPLE_N, seed: int = SAMPLE_SEED) -> DataFrame:
    """Deterministic seeded sample of at most ``n`` rows: the ``n`` smallest md5(key, seed)
    (TakeOrderedAndProject, no full sort, same rows under any partitioning)."""
    return df.withColumn("_h", hash_order_key(key, seed)).orderBy("_h").limit(n).drop("_h")


@query("sample_n", with_products(f"""SELECT product_id, source_store, price, rating FROM products
ORDER BY md5((product_id || '|' || source_store) || '#{SAMPLE_SEED}') LIMIT {SAMPLE_N}"""))
def q_sample_n(spark: SparkSession, sf: str) -> DataFrame:
    p = processed_products(spark, sf)
    key = F.concat_ws("|", "product_id", "source_store")
    return sample_n(p, key).select("product_id", "source_store", "price", "rating")


def collapsed(products: DataFrame, by: list[str], numbers: dict[str, F.Column]) -> DataFrame:
    """One scan for several counts: a row per combination of ``by`` with its number of rows ``n`` and, of each of the
    ``numbers``, the sum ``s_`` and the count ``c_`` of values. Written, as a report reads it several times; totals and
    each column's counts add up these few rows, so no product row is multiplied."""
    sums = [e for k, v in numbers.items() for e in (F.sum(v.cast("double")).alias(f"s_{k}"), F.count(v).alias(f"c_{k}"))]
    return materialize(products.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *sums), "report-counts")


def _mean(name: str, digits: int, times: float = 1.0) -> F.Column:
    return R(F.try_divide(F.sum(f"s_{name}"), F.sum(f"c_{name}")) * F.lit(times), digits)


def _summary(counts: DataFrame, totals: dict[str, F.Column]) -> DataFrame:
    """Totals over all rows as (section, item, value) rows, also of an empty table."""
    wide = counts.agg(*[v.cast("double").alias(k) for k, v in totals.items()])
    stack = ", ".join(f"'{c}', {c}" for c in totals)
    return wide.selectExpr("'summary' AS section", f"stack({len(totals)}, {stack}) AS (item, value)")


def _section(counts: DataFrame, column: str, name: str, n: int | None = None, share: bool = False) -> DataFrame:
    """Rows (or their share in %) per value of a column, optionally of the ``n`` most frequent (ties by value)."""
    g = counts.groupBy(F.col(column).alias("item")).agg(F.sum("n").alias("n"))
    if n is not None:
        g = g.orderBy(F.col("n").desc(), F.col("item").asc()).limit(n)
    value = R(F.col("n") / counts.select(F.sum("n")).scalar() * F.lit(100.0), 1) if share else F.col("n").cast("double")
    return g.select(F.lit(name).alias("section"), "item", value.alias("value"))


def final_report(products: DataFrame) -> DataFrame:
    """Long-form (section, item, value) table: totals, coverage, top-10 categories, segments, labels."""
    counts = collapsed(products, ["category", "price_segment"], {
        "nulls": sum(F.col(c).isNull().cast("int") for c in products.columns),
        "described": (F.trim("description") != "").cast("int"), "topk": F.col("topk_label")})
    totals = _summary(counts, {
        "total_products": F.coalesce(F.sum("n"), F.lit(0)), "columns": F.lit(len(products.columns)), "null_values": F.sum("s_nulls"),
        "description_coverage_pct": _mean("described", 1, 100.0), "topk_1": F.sum("s_topk"), "topk_1_pct": _mean("topk", 1, 100.0)})
    return totals.unionByName(_section(counts, "category", "category", 10)) \
                 .unionByName(_section(counts, "price_segment", "segment_pct", share=True))


@query("final_report", with_products_ctes(f"""tot AS (SELECT count(*) AS n,
  {' + '.join(f'count(*) FILTER (WHERE {c} IS NULL)' for c in ['product_id', 'source_platform', 'source_store', 'name', 'description', 'category', 'brand', 'price', 'price_original', 'discount_pct', 'rating', 'review_count', 'in_stock', 'stock_qty', 'shop_country', 'days_since_publish', 'is_on_promo', 'price_segment', 'popularity_score', 'topk_label'])} AS nulls,
  {rnd("avg(CAST(trim(description) <> '' AS DOUBLE)) * 100.0::DOUBLE", 1)} AS desc_cov,
  sum(topk_label) AS t1, {rnd('avg(CAST(topk_label AS DOUBLE)) * 100.0::DOUBLE', 1)} AS t1p FROM products),
cats AS (SELECT category, count(*) AS c FROM products GROUP BY category ORDER BY c DESC, category LIMIT 10),
segs AS (SELECT price_segment, {rnd('count(*) / sum(count(*)) OVER () * 100.0::DOUBLE', 1)} AS s FROM products GROUP BY price_segment)
SELECT 'summary' AS section, 'total_products' AS item, CAST(n AS DOUBLE) AS value FROM tot
UNION ALL SELECT 'summary', 'columns', 20.0 FROM tot
UNION ALL SELECT 'summary', 'null_values', CAST(nulls AS DOUBLE) FROM tot
UNION ALL SELECT 'summary', 'description_coverage_pct', desc_cov FROM tot
UNION ALL SELECT 'summary', 'topk_1', CAST(t1 AS DOUBLE) FROM tot
UNION ALL SELECT 'summary', 'topk_1_pct', t1p FROM tot
UNION ALL SELECT 'category', category, CAST(c AS DOUBLE) FROM cats
UNION ALL SELECT 'segment_pct', price_segment, s FROM segs"""))
def q_final_report(spark: SparkSession, sf: str) -> DataFrame:
    return final_report(processed_products(spark, sf))


def dataset_stats(products: DataFrame) -> DataFrame:
    """The statistics document of the reports, long form (section, item, value)."""
    flags = {"in_stock": F.col("in_stock").cast("int"), "promo": F.col("is_on_promo").cast("int"), "topk": F.col("topk_label")}
    counts = collapsed(products, ["source_store", "category", "price_segment"], {"price": F.col("price"), "rating": F.col("rating"), **flags})
    totals = _summary(counts, {
        "total_products": F.coalesce(F.sum("n"), F.lit(0)), "avg_price": _mean("price", 2), "avg_rating": _mean("rating", 2),
        "in_stock_pct": _mean("in_stock", 1, 100.0), "on_promo_pct": _mean("promo", 1, 100.0),
        "topk_count": F.sum("s_topk"), "topk_pct": _mean("topk", 1, 100.0)})
    return totals.unionByName(_section(counts, "source_store", "sources")) \
                 .unionByName(_section(counts, "category", "categories", 8)) \
                 .unionByName(_section(counts, "price_segment", "price_segments"))


@query("dataset_stats", with_products_ctes(f"""k AS ({KPIS_SELECT})
SELECT 'summary' AS section, 'total_products' AS item, CAST(total_products AS DOUBLE) AS value FROM k
UNION ALL SELECT 'summary', 'avg_price', avg_price FROM k
UNION ALL SELECT 'summary', 'avg_rating', avg_rating FROM k
UNION ALL SELECT 'summary', 'in_stock_pct', in_stock_pct FROM k
UNION ALL SELECT 'summary', 'on_promo_pct', on_promo_pct FROM k
UNION ALL SELECT 'summary', 'topk_count', CAST(topk_count AS DOUBLE) FROM k
UNION ALL SELECT 'summary', 'topk_pct', topk_pct FROM k
UNION ALL SELECT 'sources', source_store, CAST(count(*) AS DOUBLE) FROM products GROUP BY source_store
UNION ALL (SELECT 'categories', category, CAST(count(*) AS DOUBLE) FROM products GROUP BY category
           ORDER BY count(*) DESC, category LIMIT 8)
UNION ALL SELECT 'price_segments', price_segment, CAST(count(*) AS DOUBLE) FROM products GROUP BY price_segment"""))
def q_dataset_stats(spark: SparkSession, sf: str) -> DataFrame:
    return dataset_stats(processed_products(spark, sf))


ENRICH_MAX_LEN = 50


def enrichment_candidates(products: DataFrame, max_len: int = ENRICH_MAX_LEN, n: int | None = None) -> DataFrame:
    """Products whose description is shorter than ``max_len``: all, or the first ``n`` by key."""
    c = products.filter(F.length("description") < max_len)
    return c if n is None else c.orderBy("product_id", "source_store").limit(n)


@query("enrichment_candidates", with_products(f"""SELECT product_id, source_store, description FROM products
WHERE length(description) < {ENRICH_MAX_LEN}"""))
def q_enrichment_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return enrichment_candidates(processed_products(spark, sf)).select("product_id", "source_store", "description")


def apply_enrichment(products: DataFrame, generated: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Left-join generated texts back: description_enriched = new text or the old one, plus a flag. ``generated`` holds
    texts, or the numbers (doc_id) of ``texts``: then the texts are joined last and go straight into the result."""
    g = generated.select("product_id", "source_store", F.col("text" if texts is None else "doc_id").alias("_new"))
    j = products.join(g, ["product_id", "source_store"], "left")
    if texts is not None:
        numbered = j.where(F.col("_new").isNotNull()).withColumnRenamed("_new", "_number")
        # a merge join: rows come sorted by number, so equal texts lie side by side and the result's files pack them
        found = numbered.join(texts.select(F.col("doc_id").alias("_number"), F.col("text").alias("_new")).hint("merge"), "_number", "left")
        # rows without a number are no hot key of that join
        rest = j.where(F.col("_new").isNull()).withColumn("_new", F.lit(None).cast("string"))
        j = found.drop("_number").unionByName(rest)
    return j.withColumn("description_enriched", F.coalesce(F.col("_new"), F.col("description"))) \
            .withColumn("is_enriched", F.col("_new").isNotNull()).drop("_new")


def given_texts(candidates: DataFrame, texts: DataFrame) -> DataFrame:
    """The number (doc_id) of the text that each candidate is given from a table of ready ones: the MD5 of its key
    modulo the greatest doc_id plus one, so that the texts used grow with the table; a product whose number has no
    text keeps its own."""
    key = F.md5(F.concat_ws("|", "product_id", "source_store"))
    numbers = texts.agg(F.max("doc_id") + 1).scalar()
    number = F.pmod(F.conv(F.substring(key, 1, 8), 16, 10).cast("long"), numbers)
    return candidates.select("product_id", "source_store", number.alias("doc_id"))


@query("apply_enrichment", with_products_ctes(f"""gen AS (
  SELECT p.product_id, p.source_store, d.text FROM products p JOIN documents d
    ON d.doc_id = CAST('0x' || substr(md5(p.product_id || '|' || p.source_store), 1, 8) AS BIGINT) % (SELECT max(doc_id) + 1 FROM documents)
  WHERE length(p.description) < {ENRICH_MAX_LEN})
SELECT p.product_id, p.source_store, coalesce(g.text, p.description) AS description_enriched, g.text IS NOT NULL AS is_enriched
FROM products p LEFT JOIN gen g ON p.product_id = g.product_id AND p.source_store = g.source_store"""))
def q_apply_enrichment(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of ``documents`` written back to every product with a short description."""
    p = processed_products(spark, sf).select("product_id", "source_store", "description")
    texts = read_table(spark, sf, "documents").select("doc_id", "text")
    return apply_enrichment(p, given_texts(enrichment_candidates(p), texts), texts).select("product_id", "source_store", "description_enriched", "is_enriched")


@query("union_sources", with_raw_ctes(landed_cte() + """
SELECT source_platform, source_store, count(*) AS n, count(rating) AS n_rating FROM (
  SELECT source_platform, source_store, product_id, price, NULL::DOUBLE AS rating FROM landed WHERE source_platform = 'shopify'
  UNION ALL
  SELECT source_platform, source_store, product_id, price, rating FROM landed WHERE source_platform = 'woocommerce') u
GROUP BY source_platform, source_store"""))
def q_union_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Per-platform frames with different column sets concatenated by name (missing columns null)."""
    landed = landed_products(spark, sf)
    shop = landed.filter(F.col("source_platform") == "shopify").select("source_platform", "source_store", "product_id", "price")
    woo = landed.filter(F.col("source_platform") == "woocommerce").select("source_platform", "source_store", "product_id",
                                                                          "price", "rating")
    u = shop.unionByName(woo, allowMissingColumns=True)
    return u.groupBy("source_platform", "source_store").agg(F.count(F.lit(1)).alias("n"), F.count("rating").alias("n_rating"))


def variants_of_product(products: DataFrame, variants: DataFrame) -> DataFrame:
    """Parent-child join on product_id: per product the variant count, price range and sorted ids.
    The variants are aggregated per product first, so the join is one row per product."""
    v = variants.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("n_variants"), F.min("price").alias("min_variant_price"),
        F.max("price").alias("max_variant_price"), F.count_if(F.coalesce(F.col("available"), F.lit(True))).alias("n_available"))
    return products.select("product_id", "source_store").join(v, "product_id", "left")


@query("variants_of_product", with_products_ctes(f"""raw_variants AS ({RAW_VARIANTS_SQL}),
v AS (SELECT product_id, count(*) AS n_variants, min(price) AS min_variant_price, max(price) AS max_variant_price,
      count(*) FILTER (WHERE coalesce(available, TRUE)) AS n_available FROM raw_variants GROUP BY product_id)
SELECT p.product_id, p.source_store, v.n_variants, v.min_variant_price, v.max_variant_price, v.n_available
FROM products p LEFT JOIN v ON p.product_id = v.product_id"""))
def q_variants_of_product(spark: SparkSession, sf: str) -> DataFrame:
    return variants_of_product(processed_products(spark, sf), raw_variants(spark, sf))
