"""Data-quality reports over the landed catalog: per-source scores, audit counters, readiness gate.

Every report is one grouped pass (``groupBy(...).agg`` combines map-side, so a store holding a third
of the rows costs no more than the others) followed by a reshaping of a handful of result rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions.numeric import round_half_up
from ..oracle.catalog import rnd, with_raw_ctes
from ..operators.dedup import distinct_values, duplicates_by
from ..operators.quantiles import exact_quantiles
from ..registry import query
from ..sources.adapters import RAW_VARIANTS_SQL, raw_variants
from .landing import PRODUCT_CONTRACT, VARIANT_CONTRACT, landed_cte, landed_products

QUALITY_COLS = C.QUALITY_CRITICAL + C.QUALITY_ENRICHABLE


def _missing(col: str) -> F.Column:
    c = F.col(col)
    if col == "description":
        return c.isNull() | (F.trim(c) == "")
    if col == "price":
        return c.isNull() | (c == 0)
    return c.isNull()


def _distinct_with_null(col: str) -> F.Column:
    """Number of distinct values, null counted as one value (pandas ``duplicated`` semantics)."""
    return F.count_distinct(F.col(col)) + F.max(F.col(col).isNull().cast("int"))


def source_quality(df: DataFrame) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("total_products")]
    aggs += [F.count_if(_missing(c)).alias(f"_m_{c}") for c in QUALITY_COLS]
    aggs += [
        F.count_if(F.coalesce(F.col("price"), F.lit(0.0)) == 0).alias("price_zero"),
        F.avg((F.coalesce(F.col("discount_pct"), F.lit(0.0)) > 0).cast("double")).alias("_promo"),
        F.bool_or(F.col("rating").isNotNull()).alias("has_real_rating"),
        F.avg(F.coalesce(F.col("in_stock"), F.lit(True)).cast("double")).alias("_instock"),
    ]
    g = df.groupBy(F.col("source_store").alias("source")).agg(*aggs)
    for c, out in (("name", "dup_names"), ("product_id", "dup_ids")):
        rest = duplicates_by(df, "source_store", c, out).withColumnRenamed("source_store", "_store")
        g = g.join(rest, F.col("source").eqNullSafe(F.col("_store"))).drop("_store")  # a row per store on both sides
    n = F.col("total_products")
    for c in QUALITY_COLS:
        g = g.withColumn(f"{c}_missing_pct", round_half_up(F.col(f"_m_{c}") / n * F.lit(100.0), 1))
    pen = F.lit(0.0)
    for c in C.QUALITY_CRITICAL:
        pen = pen + F.col(f"{c}_missing_pct") * F.lit(2.0)
    for c in C.QUALITY_ENRICHABLE:
        pen = pen + F.col(f"{c}_missing_pct") * F.lit(0.5)
    pen = pen + (F.col("dup_ids") / n * F.lit(100.0)) * F.lit(3.0)
    pen = pen + (F.col("dup_names") / n * F.lit(100.0)) * F.lit(1.0)
    pen = pen + (F.col("price_zero") / n * F.lit(100.0)) * F.lit(3.0)
    raw = F.greatest(F.lit(0.0), F.lit(100.0) - pen / F.lit(7.0))
    hi, mid, lo = C.QUALITY_CUTS
    rec = (F.when(raw >= hi, C.QUALITY_RECOMMENDATIONS[0]).when(raw >= mid, C.QUALITY_RECOMMENDATIONS[1])
           .when(raw >= lo, C.QUALITY_RECOMMENDATIONS[2]).otherwise(C.QUALITY_RECOMMENDATIONS[3]))
    return g.select(
        "source", "total_products", *[f"{c}_missing_pct" for c in QUALITY_COLS],
        "dup_names", "dup_ids", "price_zero",
        round_half_up(F.col("_promo") * F.lit(100.0), 1).alias("on_promo_pct"),
        "has_real_rating",
        round_half_up(F.col("_instock") * F.lit(100.0), 1).alias("in_stock_pct"),
        round_half_up(raw, 1).alias("quality_score"), rec.alias("recommendation"),
        raw.alias("_raw_score"),
    )


def _source_quality_sql() -> str:
    m = {"description": "description IS NULL OR trim(description) = ''",
         "price": "price IS NULL OR price = 0"}
    counts = ",\n       ".join(f"count(*) FILTER (WHERE {m.get(c, c + ' IS NULL')}) AS m_{c}" for c in QUALITY_COLS)
    pcts = ",\n       ".join(f"{rnd(f'm_{c} / total_products * 100.0::DOUBLE', 1)} AS {c}_missing_pct"
                             for c in QUALITY_COLS)
    pen = "0.0::DOUBLE"
    for c in C.QUALITY_CRITICAL:
        pen = f"({pen} + {c}_missing_pct * 2.0::DOUBLE)"
    for c in C.QUALITY_ENRICHABLE:
        pen = f"({pen} + {c}_missing_pct * 0.5::DOUBLE)"
    pen = f"({pen} + (dup_ids / total_products * 100.0::DOUBLE) * 3.0::DOUBLE)"
    pen = f"({pen} + (dup_names / total_products * 100.0::DOUBLE) * 1.0::DOUBLE)"
    pen = f"({pen} + (price_zero / total_products * 100.0::DOUBLE) * 3.0::DOUBLE)"
    r = C.QUALITY_RECOMMENDATIONS
    return f"""{landed_cte()},
g AS (SELECT source_store AS source, count(*) AS total_products,
       {counts},
       count(*) - (count(DISTINCT name) + max(CAST(name IS NULL AS INT))) AS dup_names,
       count(*) - (count(DISTINCT product_id) + max(CAST(product_id IS NULL AS INT))) AS dup_ids,
       count(*) FILTER (WHERE coalesce(price, 0.0) = 0) AS price_zero,
       avg(CAST(coalesce(discount_pct, 0.0) > 0 AS DOUBLE)) AS promo,
       bool_or(rating IS NOT NULL) AS has_real_rating,
       avg(CAST(coalesce(in_stock, TRUE) AS DOUBLE)) AS instock
       FROM landed GROUP BY source_store),
p AS (SELECT *, {pcts} FROM g),
s AS (SELECT *, greatest(0.0::DOUBLE, 100.0::DOUBLE - {pen} / 7.0::DOUBLE) AS raw_score FROM p)
SELECT source, total_products, {', '.join(f'{c}_missing_pct' for c in QUALITY_COLS)},
       dup_names, dup_ids, price_zero, {rnd('promo * 100.0::DOUBLE', 1)} AS on_promo_pct, has_real_rating,
       {rnd('instock * 100.0::DOUBLE', 1)} AS in_stock_pct, {rnd('raw_score', 1)} AS quality_score,
       CASE WHEN raw_score >= 75 THEN '{r[0]}' WHEN raw_score >= 50 THEN '{r[1]}'
            WHEN raw_score >= 30 THEN '{r[2]}' ELSE '{r[3]}' END AS recommendation
FROM s"""


@query("source_quality", with_raw_ctes(_source_quality_sql()))
def q_source_quality(spark: SparkSession, sf: str) -> DataFrame:
    return source_quality(landed_products(spark, sf)).drop("_raw_score")


def impact_analysis(df: DataFrame, report: DataFrame, keep_score: float = C.QUALITY_KEEP_SCORE,
                    min_rows: int = C.MIN_ROWS_FOR_ML) -> DataFrame:
    """Rows and sources kept / removed when sources scoring below ``keep_score`` are dropped."""
    kept = report.filter(F.col("_raw_score") >= keep_score).select(F.col("source").alias("source_store"))
    kept_rows = df.join(kept, "source_store", "left_semi").agg(F.count(F.lit(1)).alias("kept_rows"))
    total = df.agg(F.count(F.lit(1)).alias("total_rows"))
    n_src = kept.agg(F.count(F.lit(1)).alias("kept_sources"))
    t = total.select(F.col("total_rows"), kept_rows.select("kept_rows").scalar().alias("kept_rows"),
                     n_src.select("kept_sources").scalar().alias("kept_sources"))
    return t.select("total_rows", "kept_sources", "kept_rows",
                    (F.col("total_rows") - F.col("kept_rows")).alias("removed_rows"),
                    round_half_up(F.col("kept_rows") / F.col("total_rows") * F.lit(100.0), 1).alias("kept_pct"),
                    (F.col("kept_rows") >= min_rows).alias("enough_for_ml"))


@query("impact_analysis", with_raw_ctes(_source_quality_sql().rsplit("SELECT source,", 1)[0].rstrip() + f""",
k AS (SELECT source FROM s WHERE raw_score >= {C.QUALITY_KEEP_SCORE})
SELECT (SELECT count(*) FROM landed) AS total_rows, (SELECT count(*) FROM k) AS kept_sources,
       (SELECT count(*) FROM landed WHERE source_store IN (SELECT source FROM k)) AS kept_rows,
       (SELECT count(*) FROM landed WHERE source_store NOT IN (SELECT source FROM k)) AS removed_rows,
       {rnd("(SELECT count(*) FROM landed WHERE source_store IN (SELECT source FROM k)) / (SELECT count(*) FROM landed) * 100.0::DOUBLE", 1)} AS kept_pct,
       (SELECT count(*) FROM landed WHERE source_store IN (SELECT source FROM k)) >= {C.MIN_ROWS_FOR_ML} AS enough_for_ml"""))
def q_impact_analysis(spark: SparkSession, sf: str) -> DataFrame:
    df = landed_products(spark, sf)
    return impact_analysis(df, source_quality(df))


def _kept_sources_sql(keep: bool) -> str:
    base = _source_quality_sql().rsplit("SELECT source,", 1)[0].rstrip()
    op = "IN" if keep else "NOT IN"
    return with_raw_ctes(base + f""",
k AS (SELECT source FROM s WHERE raw_score >= {C.QUALITY_KEEP_SCORE})
SELECT product_id, source_store, name, price FROM landed WHERE source_store {op} (SELECT source FROM k)""")


@query("keep_sources_semi", _kept_sources_sql(True))
def q_keep_sources_semi(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of sources scoring >= 30 (left-semi join with the kept-source list)."""
    df = landed_products(spark, sf)
    kept = source_quality(df).filter(F.col("_raw_score") >= C.QUALITY_KEEP_SCORE) \
        .select(F.col("source").alias("source_store"))
    return df.join(kept, "source_store", "left_semi").select("product_id", "source_store", "name", "price")


@query("drop_sources_anti", _kept_sources_sql(False))
def q_drop_sources_anti(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that go when low-scoring sources are dropped (left-anti join)."""
    df = landed_products(spark, sf)
    kept = source_quality(df).filter(F.col("_raw_score") >= C.QUALITY_KEEP_SCORE) \
        .select(F.col("source").alias("source_store"))
    return df.join(kept, "source_store", "left_anti").select("product_id", "source_store", "name", "price")


def basic_counts(products: DataFrame, variants: DataFrame) -> DataFrame:
    p = products.agg(F.count(F.lit(1)).alias("total_products"))
    p = p.select("*", *[distinct_values(products, c).alias(n) for c, n in (
        ("source_store", "n_sources"), ("category", "n_categories"), ("brand", "n_brands"))])
    return p.withColumn("total_variants", variants.select(F.count(F.lit(1))).scalar())


@query("basic_counts", with_raw_ctes(f"""raw_variants AS ({RAW_VARIANTS_SQL})
SELECT count(*) AS total_products, count(DISTINCT source_store) AS n_sources,
       count(DISTINCT category) AS n_categories, count(DISTINCT brand) AS n_brands,
       (SELECT count(*) FROM raw_variants) AS total_variants FROM raw_products"""))
def q_basic_counts(spark: SparkSession, sf: str) -> DataFrame:
    return basic_counts(landed_products(spark, sf), raw_variants(spark, sf))


def missing_report(df: DataFrame) -> DataFrame:
    """Null count and % per column, only columns with nulls (one pass, then unpivot)."""
    cols = df.columns
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    long = wide.unpivot("_n", cols, "column_name", "missing_count")
    return (long.filter(F.col("missing_count") > 0)
                .select("column_name", F.col("missing_count").cast("long").alias("missing_count"),
                        round_half_up(F.col("missing_count") / F.col("_n") * F.lit(100.0), 1).alias("missing_pct")))


def _missing_report_sql(cols) -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS missing_count, count(*) AS n FROM landed"
        for c in cols)
    return f"""{landed_cte()}
SELECT column_name, CAST(missing_count AS BIGINT) AS missing_count, {rnd('missing_count / n * 100.0::DOUBLE', 1)} AS missing_pct
FROM ({parts}) t WHERE missing_count > 0"""


@query("missing_report", with_raw_ctes(_missing_report_sql(PRODUCT_CONTRACT)))
def q_missing_report(spark: SparkSession, sf: str) -> DataFrame:
    return missing_report(landed_products(spark, sf))


# FIXED VALUES: the eight "present but useless" counters.
ZERO_CHECKS = [
    ("price == 0", "price = 0"),
    ("price_original == 0", "price_original = 0"),
    ("discount_pct == 0", "discount_pct = 0"),
    ("review_count == 0", "review_count = 0"),
    ("stock_qty == 0", "stock_qty = 0"),
    ("description empty", "trim(coalesce(description, '')) = ''"),
    ("category uncategorized", "category = 'uncategorized'"),
    ("brand unknown", "brand = 'unknown'"),
]


def zero_empty_report(df: DataFrame) -> DataFrame:
    wide = df.agg(*[F.count_if(F.expr(cond)).alias(f"c{i}") for i, (_, cond) in enumerate(ZERO_CHECKS)])
    stack = ", ".join(f"'{name}', c{i}" for i, (name, _) in enumerate(ZERO_CHECKS))
    return wide.selectExpr(f"stack({len(ZERO_CHECKS)}, {stack}) AS (check_name, n)") \
               .select("check_name", F.col("n").cast("long").alias("n"))


@query("zero_empty_report", with_raw_ctes(landed_cte() + "\n" + " UNION ALL ".join(
    f"SELECT '{name}' AS check_name, CAST(count(*) FILTER (WHERE {cond}) AS BIGINT) AS n FROM landed"
    for name, cond in ZERO_CHECKS)))
def q_zero_empty_report(spark: SparkSession, sf: str) -> DataFrame:
    return zero_empty_report(landed_products(spark, sf))


def describe(df: DataFrame, col: str) -> DataFrame:
    """count, mean, sample std, min, exact interpolated quartiles, max (rounded to 2)."""
    c = F.col(col)
    out = df.agg(F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
                 F.min(c).alias("min"), F.max(c).alias("max"))
    out = out.withColumn("_q", exact_quantiles(df, col, [0.25, 0.5, 0.75], out="_q").scalar())
    return out.select("count", *[round_half_up(x, 2).alias(n) for x, n in [
        (F.col("mean"), "mean"), (F.col("std"), "std"), (F.col("min"), "min"),
        (F.col("_q")[0], "p25"), (F.col("_q")[1], "p50"), (F.col("_q")[2], "p75"), (F.col("max"), "max")]])


@query("describe_price", with_raw_ctes(landed_cte() + f"""
SELECT count(price) AS count, {rnd('avg(price)', 2)} AS mean, {rnd('stddev_samp(price)', 2)} AS std,
       {rnd('min(price)', 2)} AS min, {rnd('quantile_cont(price, 0.25)', 2)} AS p25,
       {rnd('quantile_cont(price, 0.5)', 2)} AS p50, {rnd('quantile_cont(price, 0.75)', 2)} AS p75,
       {rnd('max(price)', 2)} AS max FROM landed"""))
def q_describe_price(spark: SparkSession, sf: str) -> DataFrame:
    return describe(landed_products(spark, sf), "price")


def rating_coverage(df: DataFrame) -> DataFrame:
    r = F.col("rating")
    return df.agg(F.count(r).alias("has_rating"), F.count_if(r.isNull()).alias("missing_rating"),
                  round_half_up(F.count(r) / F.count(F.lit(1)) * F.lit(100.0), 1).alias("has_rating_pct"),
                  round_half_up(F.count_if(r.isNull()) / F.count(F.lit(1)) * F.lit(100.0), 1).alias("missing_rating_pct"),
                  F.min(r).alias("min_rating"), F.max(r).alias("max_rating"),
                  round_half_up(F.avg(r), 2).alias("mean_rating"))


@query("rating_coverage", with_raw_ctes(landed_cte() + f"""
SELECT count(rating) AS has_rating, count(*) FILTER (WHERE rating IS NULL) AS missing_rating,
       {rnd('count(rating) / count(*) * 100.0::DOUBLE', 1)} AS has_rating_pct,
       {rnd('count(*) FILTER (WHERE rating IS NULL) / count(*) * 100.0::DOUBLE', 1)} AS missing_rating_pct,
       min(rating) AS min_rating, max(rating) AS max_rating, {rnd('avg(rating)', 2)} AS mean_rating FROM landed"""))
def q_rating_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return rating_coverage(landed_products(spark, sf))


def stock_coverage(df: DataFrame) -> DataFrame:
    s = F.coalesce(F.col("in_stock"), F.lit(True))
    return df.agg(F.count_if(F.col("in_stock")).alias("in_stock_true"),
                  F.count_if(~s).alias("in_stock_false"),
                  F.count("stock_qty").alias("has_stock_qty"),
                  round_half_up(F.count("stock_qty") / F.count(F.lit(1)) * F.lit(100.0), 1).alias("has_stock_qty_pct"))


@query("stock_coverage", with_raw_ctes(landed_cte() + f"""
SELECT count(*) FILTER (WHERE in_stock) AS in_stock_true,
       count(*) FILTER (WHERE NOT coalesce(in_stock, TRUE)) AS in_stock_false,
       count(stock_qty) AS has_stock_qty,
       {rnd('count(stock_qty) / count(*) * 100.0::DOUBLE', 1)} AS has_stock_qty_pct FROM landed"""))
def q_stock_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return stock_coverage(landed_products(spark, sf))


def duplicate_counts(df: DataFrame) -> DataFrame:
    """Rows beyond the first per product_id and per name (null is a key of its own)."""
    return df.agg((F.count(F.lit(1)) - _distinct_with_null("product_id")).alias("dup_product_id"),
                  (F.count(F.lit(1)) - _distinct_with_null("name")).alias("dup_name"))


@query("duplicate_counts", with_raw_ctes(landed_cte() + """
SELECT count(*) - (count(DISTINCT product_id) + max(CAST(product_id IS NULL AS INT))) AS dup_product_id,
       count(*) - (count(DISTINCT name) + max(CAST(name IS NULL AS INT))) AS dup_name FROM landed"""))
def q_duplicate_counts(spark: SparkSession, sf: str) -> DataFrame:
    return duplicate_counts(landed_products(spark, sf))


# FIXED VALUES: readiness checks, in order, and the verdicts for 7, >= 5 and fewer passed checks.
READINESS_CHECKS = [
    "≥ 2000 products", "price coverage 100%", "category coverage >90%", "brand coverage >80%",
    "rating coverage >30%", "no duplicate IDs", "price_segment present",
]
READINESS_VERDICTS = ["Ready for ML pipeline ✓", "Minor fixes needed before ML", "Significant enrichment required"]


def readiness_score(df: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    checks = [
        n >= C.MIN_ROWS_FOR_ML,
        F.coalesce(F.bool_and(F.coalesce(F.col("price") > 0, F.lit(False))), F.lit(True)),
        F.avg((F.coalesce(F.col("category") != "uncategorized", F.lit(True))).cast("double")) > 0.9,
        F.avg((F.coalesce(F.col("brand") != "unknown", F.lit(True))).cast("double")) > 0.8,
        F.avg(F.col("rating").isNotNull().cast("double")) > 0.3,
        (n - _distinct_with_null("product_id")) == 0,
        F.coalesce(F.bool_and(F.col("price_segment").isNotNull()), F.lit(True)),
    ]
    wide = df.agg(*[c.alias(f"c{i}") for i, c in enumerate(checks)])
    stack = ", ".join(f"{i + 1}, '{name}', c{i}" for i, name in enumerate(READINESS_CHECKS))
    long = wide.selectExpr(f"stack({len(checks)}, {stack}) AS (check_no, check_name, passed)")
    total = sum(F.col(f"c{i}").cast("int") for i in range(len(checks)))
    score = wide.select(total.alias("s")).scalar()
    verdict = (F.when(score == len(checks), READINESS_VERDICTS[0]).when(score >= 5, READINESS_VERDICTS[1])
               .otherwise(READINESS_VERDICTS[2]))
    return long.select("check_no", "check_name", "passed", score.alias("score"), verdict.alias("verdict"))


def _readiness_sql() -> str:
    conds = [
        f"count(*) >= {C.MIN_ROWS_FOR_ML}",
        "coalesce(bool_and(coalesce(price > 0, FALSE)), TRUE)",
        "avg(CAST(coalesce(category <> 'uncategorized', TRUE) AS DOUBLE)) > 0.9",
        "avg(CAST(coalesce(brand <> 'unknown', TRUE) AS DOUBLE)) > 0.8",
        "avg(CAST(rating IS NOT NULL AS DOUBLE)) > 0.3",
        "count(*) - (count(DISTINCT product_id) + max(CAST(product_id IS NULL AS INT))) = 0",
        "coalesce(bool_and(price_segment IS NOT NULL), TRUE)",
    ]
    cols = ", ".join(f"{c} AS c{i}" for i, c in enumerate(conds))
    rows = " UNION ALL ".join(f"SELECT {i + 1} AS check_no, '{n}' AS check_name, c{i} AS passed FROM w"
                              for i, n in enumerate(READINESS_CHECKS))
    total = " + ".join(f"CAST(c{i} AS INT)" for i in range(len(conds)))
    v = READINESS_VERDICTS
    return with_raw_ctes(landed_cte() + f""",
w AS (SELECT {cols} FROM landed),
sc AS (SELECT {total} AS score FROM w)
SELECT r.check_no, r.check_name, r.passed, sc.score,
       CASE WHEN sc.score = 7 THEN '{v[0]}' WHEN sc.score >= 5 THEN '{v[1]}' ELSE '{v[2]}' END AS verdict
FROM ({rows}) r CROSS JOIN sc""")


@query("readiness_score", _readiness_sql())
def q_readiness_score(spark: SparkSession, sf: str) -> DataFrame:
    return readiness_score(landed_products(spark, sf))


def validate_schema(df: DataFrame, contract: list[str], table: str,
                    ranges: dict | None = None) -> DataFrame:
    """Ordered column-name check plus per-column null and range-violation counts, one pass."""
    ranges = ranges or {}
    present = [c for c in contract if c in df.columns]
    aggs = []
    for c in present:
        aggs.append(F.count_if(F.col(c).isNull()).alias(f"n_{c}"))
        cond = ranges.get(c)
        aggs.append((F.count_if(F.expr(cond)) if cond else F.lit(0).cast("long")).alias(f"v_{c}"))
    wide = df.agg(*aggs)
    order_ok = list(df.columns[:len(contract)]) == contract
    stack = ", ".join(f"{i + 1}, '{c}', n_{c}, v_{c}" for i, c in enumerate(present))
    long = wide.selectExpr(f"stack({len(present)}, {stack}) AS (position, column_name, null_count, violations)")
    return long.select(F.lit(table).alias("table_name"), "position", "column_name",
                       F.col("null_count").cast("long").alias("null_count"),
                       F.col("violations").cast("long").alias("violations"),
                       F.lit(order_ok).alias("order_ok"), F.lit(len(df.columns)).alias("n_columns"))


# FIXED VALUES: value rules checked per column (ours; the original checks names and order only).
PRODUCT_RANGES = {
    "price": "price < 0", "price_original": "price_original < price", "discount_pct": "discount_pct < 0 OR discount_pct > 100",
    "rating": "rating < 0 OR rating > 5", "review_count": "review_count < 0", "stock_qty": "stock_qty < 0",
    "price_segment": "price_segment NOT IN ('low', 'mid', 'high')",
}
VARIANT_RANGES = {"price": "price < 0", "position": "position < 1"}


def _validate_sql(contract, ranges, table, src) -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, {i + 1} AS position, '{c}' AS column_name, "
        f"CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS null_count, "
        f"CAST({('count(*) FILTER (WHERE ' + ranges[c] + ')') if c in ranges else '0'} AS BIGINT) AS violations, "
        f"TRUE AS order_ok, {len(contract)} AS n_columns FROM {src}"
        for i, c in enumerate(contract))
    return rows


@query("validate_schema", with_raw_ctes(
    landed_cte() + f""",
raw_variants AS ({RAW_VARIANTS_SQL})
""" + _validate_sql(PRODUCT_CONTRACT, PRODUCT_RANGES, "products", "landed") + " UNION ALL "
    + _validate_sql(VARIANT_CONTRACT, VARIANT_RANGES, "variants", "raw_variants")))
def q_validate_schema(spark: SparkSession, sf: str) -> DataFrame:
    products = validate_schema(landed_products(spark, sf), PRODUCT_CONTRACT, "products", PRODUCT_RANGES)
    variants = validate_schema(raw_variants(spark, sf).select(*VARIANT_CONTRACT), VARIANT_CONTRACT, "variants",
                               VARIANT_RANGES)
    return products.unionByName(variants)
