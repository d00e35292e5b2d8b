"""Scalar functions on hand-made rows, including the traps listed in the survey."""

from pyspark.sql import functions as F

from vitrine.functions import numeric as N
from vitrine.functions import text as T


def _one(spark, expr, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("y")).first()["y"]


def test_clean_html_entities_tags_space(spark):
    assert _one(spark, T.clean_html("x"), "<p>A &amp; <b>B</b></p>") == "A & B"
    # '&amp;lt;' decodes once to '&lt;' (amp last), escaped tags are stripped after decoding
    assert _one(spark, T.clean_html("x"), "&amp;lt;b&amp;gt;") == "&lt;b&gt;"
    assert _one(spark, T.clean_html("x"), "&lt;i&gt;hi&lt;/i&gt;") == "hi"
    assert _one(spark, T.clean_html("x"), "a  b\n\tc") == "a b c"
    assert _one(spark, T.clean_html("x"), None) == ""
    assert len(_one(spark, T.clean_html("x", 1000), "y" * 1500)) == 1000
    assert len(_one(spark, T.clean_html("x"), "y" * 1500)) == 1500


def test_clean_html_uses_full_entity_table(spark):
    assert _one(spark, T.clean_html("x"), "caf&eacute; &euro;5") == "café €5"


def test_normalize_category(spark):
    assert _one(spark, T.normalize_category("x"), "Hubs ## Stands") == "hubs"
    assert _one(spark, T.normalize_category("x"), "Sportswear/Accessories/") == "sportswear"
    assert _one(spark, T.normalize_category("x"), None) == "uncategorized"
    assert _one(spark, T.normalize_category("x"), "  ") == "uncategorized"
    assert _one(spark, T.normalize_category("x"), "/sub/") == "uncategorized"


def test_normalize_brand(spark):
    assert _one(spark, T.normalize_brand("x"), "Gym | Be a visionary.") == "Gym"
    assert _one(spark, T.normalize_brand("x"), "Acme® x") == "Acme"
    assert _one(spark, T.normalize_brand("x"), None) == "unknown"
    assert _one(spark, T.normalize_brand("x"), "") == "unknown"


def test_description_fallback(spark):
    df = spark.createDataFrame([("", "Rod", "small", "Brand#1"), ("", "Rod", "uncategorized", "unknown"),
                                ("text", "Rod", "a", "b"), ("", "Rod", "uncategorized", "B")],
                               "d string, name string, category string, brand string")
    out = [r["y"] for r in df.select(T.description_fallback("d", "name", "category", "brand").alias("y")).collect()]
    assert out == ["Rod — small | Brand#1", "Rod", "text", "Rod — B"]


def test_tags_rule_order_trap(spark):
    # "mens" is found inside "womens" and comes first
    assert _one(spark, T.infer_category_from_tags("x"), "WOMENS, swim") == "mens clothing"
    assert _one(spark, T.infer_category_from_tags("x"), "women") == "womens clothing"
    assert _one(spark, T.infer_category_from_tags("x"), None) == "mens clothing"


def test_price_segment_bin_edges(spark):
    df = spark.createDataFrame([(30.0,), (30.01,), (100.0,), (100.5,), (0.5,)], "p double")
    got = [r[0] for r in df.select(N.price_segment("p")).collect()]
    assert got == ["low", "mid", "mid", "high", "low"]
    got2 = [r[0] for r in df.select(N.ingest_price_segment("p")).collect()]
    assert got2 == ["mid", "mid", "high", "high", "low"]


def test_price_fix_and_discount(spark):
    df = spark.createDataFrame([(10.0, None), (10.0, 8.0), (10.0, 12.5)], "price double, price_original double")
    df = df.withColumn("price_original", N.fix_price_original()).withColumn("d", N.recompute_discount())
    rows = [(r["price_original"], r["d"]) for r in df.collect()]
    assert rows == [(10.0, 0.0), (10.0, 0.0), (12.5, 20.0)]


def test_round_half_up(spark):
    df = spark.createDataFrame([(2.5,), (0.125,), (-1.5,)], "x double")
    assert [r[0] for r in df.select(N.round_half_up("x", 0)).collect()] == [3.0, 0.0, -1.0]


def test_days_since_formats(spark):
    as_of = "2024-01-11 00:00:00"
    vals = ["2024-01-01T00:00:00+00:00", "2024-01-01 00:00:00", "2024-01-01T00:00:00.123456Z", "2024-01-01",
            "2024-01-01T00:00:00", "garbage", None]
    df = spark.createDataFrame([(v,) for v in vals], "x string")
    got = [r[0] for r in df.select(N.days_since("x", as_of)).collect()]
    assert got == [10, 10, 9, 10, None, None, None]


def test_text_search_null_safe(spark):
    df = spark.createDataFrame([("Red Bolt", None), (None, "bolt co"), ("x", "y")], "name string, brand string")
    assert [r[0] for r in df.select(T.text_search("BOLT", "name", "brand")).collect()] == [True, True, False]
