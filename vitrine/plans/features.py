"""Feature building: label encoding, standard scaling, feature matrix, class weight, splits (section 2.9).

Dictionaries are tables (codes of the sorted distinct values); scaling parameters are one aggregate pass read back
as scalar subqueries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import round_half_up
from ..oracle.catalog import rnd, with_products
from ..registry import query
from ..session import materialize
from .preprocess import processed_products

NUM_FEATURES = ["price", "discount_pct", "stock_qty", "days_since_publish"]
CAT_FEATURES = ["category", "brand", "source_store", "shop_country"]
BOOL_FEATURES = ["in_stock", "is_on_promo"]
ENC_FEATURES = [f"{c}_enc" for c in CAT_FEATURES]
ALL_FEATURES = NUM_FEATURES + ENC_FEATURES + BOOL_FEATURES
TARGET = "topk_label"
SCALE_DIGITS = 6


def label_encode(df: DataFrame, cols=CAT_FEATURES) -> DataFrame:
    """Index of each value in the sorted distinct values (alphabetical label encoding; null comes last).
    The dictionaries are tables: no value passes through the driver."""
    for c in cols:
        df = with_codes(df, c, dictionary(df, c))
    return df


def with_codes(df: DataFrame, col: str, codes: DataFrame) -> DataFrame:
    """``df`` with the code of ``col`` from a dictionary (_value, _code), the number of codes where it has none."""
    n = codes.agg(F.count(F.lit(1))).scalar()
    side = F.broadcast(codes) if codes.count() <= DICTIONARY_BROADCAST_ROWS else codes
    return df.join(side, F.col(col) == F.col("_value"), "left") \
             .withColumn(f"{col}_enc", F.coalesce(F.col("_code"), n).cast("int")).drop("_value", "_code")


#: Dictionaries are broadcast up to this many values, beyond it joined by a shuffle.
DICTIONARY_BROADCAST_ROWS = 200_000


def dictionary(df: DataFrame, col: str) -> DataFrame:
    """(_value, _code): codes 0, 1, ... of the distinct non-null values in order. The values are sorted in
    ranges; a value's code is its place in its range plus the sizes of the ranges before."""
    values = df.select(F.col(col).alias("_value")).where("_value is not null").distinct().orderBy("_value")
    placed = materialize(values.withColumn("_id", F.monotonically_increasing_id()), "dictionary")
    part = F.shiftright("_id", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))  # a row per range
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    coded = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return coded.select("_value", (F.col("_offset") + F.col("_id").bitwiseAND((1 << 33) - 1)).alias("_code"))


def standard_scale(df: DataFrame, cols=NUM_FEATURES, digits: int = SCALE_DIGITS, fill_zero: bool = False) -> DataFrame:
    """(x - mean) / population std per column (Spark ML's StandardScaler uses the sample std)."""
    src = df
    if fill_zero:
        df = df.fillna(0, subset=cols)
        src = df
    stats = src.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols])
    for c in cols:
        m = stats.select(f"m_{c}").scalar()
        s = stats.select(f"s_{c}").scalar()
        scaled = F.when(s == 0, F.lit(0.0)).otherwise((F.col(c) - m) / s)
        df = df.withColumn(c, round_half_up(scaled, digits))
    return df


def feature_matrix(products: DataFrame, scale: bool = True) -> DataFrame:
    # the scaling statistics are scalar subqueries over the encoded rows: encode once, to files
    df = materialize(label_encode(products), "feature_encoded")
    for c in BOOL_FEATURES:
        df = df.withColumn(c, F.col(c).cast("int"))
    if scale:
        df = standard_scale(df)
    return df.select("product_id", "source_store", "name", "popularity_score", *ALL_FEATURES, TARGET)


def _enc_sql(c):
    return f"CAST(dense_rank() OVER (ORDER BY CAST({c} AS VARCHAR)) - 1 AS INT) AS {c}_enc"


def _scaled_sql(c):
    return (f"{rnd(f'CASE WHEN stddev_pop({c}) OVER () = 0 THEN 0.0::DOUBLE ELSE ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () END', SCALE_DIGITS)} AS {c}")


@query("label_encode", with_products(f"""SELECT product_id, source_store, {', '.join(_enc_sql(c) for c in CAT_FEATURES)}
FROM products"""))
def q_label_encode(spark: SparkSession, sf: str) -> DataFrame:
    df = label_encode(processed_products(spark, sf))
    return df.select("product_id", "source_store", *ENC_FEATURES)


@query("standard_scale", with_products(f"""SELECT product_id, source_store, {', '.join(_scaled_sql(c) for c in NUM_FEATURES)}
FROM products"""))
def q_standard_scale(spark: SparkSession, sf: str) -> DataFrame:
    return standard_scale(processed_products(spark, sf)).select("product_id", "source_store", *NUM_FEATURES)


SCALE_FILL_COLS = ["price", "rating", "review_count"]


@query("scale_fillna", with_products(f"""SELECT product_id, source_store, {', '.join(_scaled_sql(c) for c in SCALE_FILL_COLS)}
FROM (SELECT product_id, source_store, coalesce(price, 0) AS price, coalesce(rating, 0) AS rating,
      coalesce(review_count, 0) AS review_count FROM products) t"""))
def q_scale_fillna(spark: SparkSession, sf: str) -> DataFrame:
    """Variant rule: nulls -> 0 first, then scale price, rating and review_count."""
    p = processed_products(spark, sf).select("product_id", "source_store", *SCALE_FILL_COLS)
    return standard_scale(p, SCALE_FILL_COLS, fill_zero=True)


@query("feature_matrix", with_products(f"""SELECT product_id, source_store, name, popularity_score,
  {', '.join(_scaled_sql(c) for c in NUM_FEATURES)}, {', '.join(_enc_sql(c) for c in CAT_FEATURES)},
  CAST(in_stock AS INT) AS in_stock, CAST(is_on_promo AS INT) AS is_on_promo, topk_label FROM products"""))
def q_feature_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return feature_matrix(processed_products(spark, sf))


def class_weight(df: DataFrame, label: str = TARGET) -> DataFrame:
    """scale_pos_weight = round(negatives / positives, 2)."""
    return df.agg(F.count_if(F.col(label) == 0).alias("neg"), F.count_if(F.col(label) == 1).alias("pos")) \
             .withColumn("scale_pos_weight", round_half_up(F.col("neg") / F.col("pos"), 2))


SPLIT_SEED = 42
TEST_SHARE = 0.2
SPLIT_BUCKETS = 256


def split_hash(key: F.Column, seed: int = SPLIT_SEED) -> F.Column:
    """60-bit pseudo-random order value from md5(key#seed), equal in DuckDB."""
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(f"#{seed}"))), 1, 15), 16, 10).cast("long")


def stratified_split(df: DataFrame, key: F.Column, label: str = TARGET, test_share: float = TEST_SHARE,
                     seed: int = SPLIT_SEED, n_buckets: int = SPLIT_BUCKETS) -> DataFrame:
    """Exact per-label test sizes ceil(share * n_label): the rows with the smallest hash per label.

    The hash order is cut into ``n_buckets`` ranges; counts per (label, bucket) give each bucket's
    offset, and only rows inside one (label, bucket) are ranked by a window, so no label (80 % of the
    rows for the negative class) lands whole in one task.
    """
    h = split_hash(key, seed)
    d = df.withColumn("_h", h).withColumn("_b", F.floor(F.col("_h") / F.lit(float(2 ** 60 // n_buckets))).cast("int"))
    counts = d.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_n"))
    wb = Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    wl = Window.partitionBy(label)
    offs = counts.select(label, "_b", F.coalesce(F.sum("_n").over(wb), F.lit(0)).alias("_off"),
                         F.ceil(F.sum("_n").over(wl) * F.lit(test_share)).alias("_k"))
    # offsets: one row per (label, bucket) -> bounded by labels x n_buckets
    d = d.join(F.broadcast(offs), [label, "_b"])
    wi = Window.partitionBy(label, "_b").orderBy("_h", "_key")
    d = d.withColumn("_key", key).withColumn("_r", F.col("_off") + F.row_number().over(wi))
    return d.withColumn("split", F.when(F.col("_r") <= F.col("_k"), "test").otherwise("train")) \
            .drop("_h", "_b", "_off", "_k", "_key", "_r")


def random_split(df: DataFrame, key: F.Column, test_share: float = TEST_SHARE, seed: int = SPLIT_SEED) -> DataFrame:
    """Unstratified: hash bucket of the key (about ``test_share`` of the rows, any partitioning)."""
    b = F.pmod(split_hash(key, seed), F.lit(100))
    return df.withColumn("split", F.when(b < int(test_share * 100), "test").otherwise("train"))


KEY_SQL = "(product_id || '|' || source_store)"
HASH_SQL = f"('0x' || substr(md5({KEY_SQL} || '#{SPLIT_SEED}'), 1, 15))::BIGINT"


@query("class_weight", with_products(f"""SELECT count(*) FILTER (WHERE topk_label = 0) AS neg,
  count(*) FILTER (WHERE topk_label = 1) AS pos,
  {rnd('count(*) FILTER (WHERE topk_label = 0) / count(*) FILTER (WHERE topk_label = 1)', 2)} AS scale_pos_weight
FROM products WHERE split = 'train'""".replace("FROM products WHERE split = 'train'", f"""FROM (SELECT *,
  CASE WHEN row_number() OVER (PARTITION BY topk_label ORDER BY {HASH_SQL}, {KEY_SQL})
            <= ceil(count(*) OVER (PARTITION BY topk_label) * {TEST_SHARE}) THEN 'test' ELSE 'train' END AS split
  FROM products) s WHERE split = 'train'""")))
def q_class_weight(spark: SparkSession, sf: str) -> DataFrame:
    """Class weight of the training split."""
    p = processed_products(spark, sf)
    tr = stratified_split(p, F.concat_ws("|", "product_id", "source_store")).filter(F.col("split") == "train")
    return class_weight(tr)


@query("stratified_split", with_products(f"""SELECT product_id, source_store, topk_label,
  CASE WHEN row_number() OVER (PARTITION BY topk_label ORDER BY {HASH_SQL}, {KEY_SQL})
            <= ceil(count(*) OVER (PARTITION BY topk_label) * {TEST_SHARE}) THEN 'test' ELSE 'train' END AS split
FROM products"""))
def q_stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    p = processed_products(spark, sf)
    return stratified_split(p, F.concat_ws("|", "product_id", "source_store")).select(
        "product_id", "source_store", "topk_label", "split")


@query("random_split", with_products(f"""SELECT product_id, source_store,
  CASE WHEN ({HASH_SQL}) % 100 < {int(TEST_SHARE * 100)} THEN 'test' ELSE 'train' END AS split FROM products"""))
def q_random_split(spark: SparkSession, sf: str) -> DataFrame:
    p = processed_products(spark, sf)
    return random_split(p, F.concat_ws("|", "product_id", "source_store")).select("product_id", "source_store", "split")
