"""Audit log by days, distinct counts without multiplied rows."""

import tempfile

import pytest
from pyspark.sql import functions as F

from vitrine.operators.dedup import distinct_values, duplicates_by
from vitrine.sources import layers


def entries(spark, counts):
    """``counts[d]`` entries on day ``d``."""
    rows = [(d * 1000 + i, i, f"2026-01-{d + 1:02d} 10:{i:02d}:00", "a", "q", "q", True, 3, False) for d, n in enumerate(counts) for i in range(n)]
    return spark.createDataFrame(rows, layers.AUDIT_SCHEMA)


@pytest.mark.parametrize("counts,most", [([5, 5, 30], 1), ([30, 5, 1, 1], 4), ([1, 1], 2), ([25] * 9, 1), ([0, 0, 0], 0)])
def test_scan_opens_no_more_days_than_it_needs(spark, monkeypatch, counts, most):
    path = tempfile.mkdtemp(prefix="vitrine-log-", dir="/tmp") + "/log"
    log = entries(spark, counts)
    layers.audit_log_sink(log, path)
    opened = []
    read = layers.read_audit_log
    monkeypatch.setattr(layers, "read_audit_log", lambda s, days: opened.append(len(days)) or read(s, days))
    got = [tuple(r) for r in layers.audit_log_scan(spark, path).collect()]
    want = [tuple(r) for r in log.orderBy(F.desc("ts"), F.desc("conv_id"), F.desc("turn")).limit(20).collect()]
    assert got == want and max(opened) == most


def test_malformed_lines_are_no_entries(spark):
    path = tempfile.mkdtemp(prefix="vitrine-log-", dir="/tmp") + "/log"
    layers.audit_log_sink(entries(spark, [10, 15]), path)
    newest = layers.audit_log_days(spark, path)[0]
    spark.createDataFrame([("{not json",), ("",)] * 20, "value string").write.mode("append").text(newest)
    assert layers.audit_log_scan(spark, path).count() == 20
    assert layers.audit_log_scan(spark, path + "-none").count() == 0


def test_distinct_counts_multiply_no_rows(spark):
    rows = [("s", "a"), ("s", "a"), ("s", None), ("s", None), ("t", "a"), (None, "b"), (None, "b"), (None, "c")]
    df = spark.createDataFrame(rows, "store string, v string")
    assert df.select(distinct_values(df, "v").alias("n")).first().n == 3
    assert {r.store: r.d for r in duplicates_by(df, "store", "v", "d").collect()} == {"s": 2, "t": 0, None: 1}
    from vitrine.plans.bi import kpis
    from vitrine.plans.quality import source_quality
    from vitrine.plans.landing import landed_products

    from .conftest import SF_SMALL

    products = spark.createDataFrame([("c", "b", "s", 1.0, 2.0, 1, True, False)], "category string, brand string, source_store string, price double, rating double, topk_label int, in_stock boolean, is_on_promo boolean")
    for out in (kpis(products), source_quality(landed_products(spark, SF_SMALL))):
        assert "Expand" not in out._jdf.queryExecution().executedPlan().toString()


def test_reports_scan_once_and_stand_an_empty_table(spark):
    from vitrine.plans.bi import collapsed, dataset_stats, final_report

    cols = "category string, price_segment string, source_store string, description string, price double, rating double, topk_label int, in_stock boolean, is_on_promo boolean"
    rows = [("c", "low", "s", " ", 1.0, None, 1, True, None), ("c", None, "s", "d", 2.0, None, 0, False, True), (None, "low", "t", None, None, None, 0, True, True)]
    df = spark.createDataFrame(rows, cols)
    got = {(r.section, r.item): r.value for r in final_report(df).collect()}
    assert got["summary", "total_products"] == 3 and got["summary", "null_values"] == 8 and got["summary", "description_coverage_pct"] == 50.0
    assert got["category", "c"] == 2 and got["category", None] == 1 and got["segment_pct", "low"] == 66.7
    stats = {(r.section, r.item): r.value for r in dataset_stats(df).collect()}
    assert stats["summary", "avg_price"] == 1.5 and stats["summary", "avg_rating"] is None and stats["summary", "on_promo_pct"] == 100.0
    assert stats["sources", "s"] == 2 and stats["price_segments", None] == 1
    assert {r.item: r.value for r in final_report(df.limit(0)).collect()}["total_products"] == 0
    assert "Expand" not in collapsed(df, ["category"], {"p": F.col("price")})._jdf.queryExecution().executedPlan().toString()
