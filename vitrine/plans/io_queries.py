"""Registered storage round trips (section 2.1): each query writes under the session's shared folder
with the I/O functions of ``sources.layers`` and reads the result back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..oracle.catalog import with_products, with_raw_ctes
from ..registry import query
from ..sources.layers import (append_ingest, audit_log_days, audit_log_scan, audit_log_sink, csv_export, layer_base,
                              layer_path, read_audit_log, read_json_result, read_layer, write_json_result, write_layer)
from ..sources.tables import read_table
from .bi import KPIS_SELECT, KPIS_SQL, kpis
from .features import CAT_FEATURES, ENC_FEATURES, dictionary, with_codes
from .landing import landed_cte, landed_products
from .preprocess import processed_products
from .preprocess_queries import TOPK_SQL, topk_products
from .routing import AUDIT_SQL, audit_rows


@query("write_layer", with_products("SELECT * FROM products"))
def q_write_layer(spark: SparkSession, sf: str) -> DataFrame:
    """Processed table written as CSV with header, read back with the explicit schema."""
    p = processed_products(spark, sf)
    base = layer_base(spark)
    write_layer(p, base, "processed", "products", fmt="csv")
    return read_layer(spark, base, "processed", "products", schema=p.schema, fmt="csv")


@query("read_layer", with_products("SELECT * FROM products"))
def q_read_layer(spark: SparkSession, sf: str) -> DataFrame:
    p = processed_products(spark, sf)
    base = layer_base(spark)
    write_layer(p, base, "processed", "products")
    return read_layer(spark, base, "processed", "products", schema=p.schema)


@query("write_json_result", KPIS_SQL)
def q_write_json_result(spark: SparkSession, sf: str) -> DataFrame:
    """KPI document written as JSON text and read back with its schema."""
    k = kpis(processed_products(spark, sf))
    base = layer_base(spark)
    write_json_result(k, base, "kpis")
    return read_json_result(spark, base, "kpis", k.schema)


@query("read_json_result", with_products(
    "SELECT 'catalog' AS report, total_products, topk_count, avg_price FROM (" + KPIS_SELECT + ") k"))
def q_read_json_result(spark: SparkSession, sf: str) -> DataFrame:
    """A nested result document (KPIs under a 'kpis' object) read with a nested schema and flattened."""
    k = kpis(processed_products(spark, sf))
    doc = k.select(F.struct(*k.columns).alias("kpis"), F.lit("catalog").alias("report"))
    base = layer_base(spark)
    write_json_result(doc, base, "report")
    back = read_json_result(spark, base, "report", doc.schema)
    return back.select("report", "kpis.total_products", "kpis.topk_count", "kpis.avg_price")


@query("model_io", with_products("SELECT product_id, source_store, " + ", ".join(
    f"CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS INT) AS {c}_enc" for c in CAT_FEATURES) + " FROM products"))
def q_model_io(spark: SparkSession, sf: str) -> DataFrame:
    """Encoders saved as dictionary tables, loaded back and applied; no label passes through the driver."""
    p = processed_products(spark, sf)
    base = layer_base(spark)
    for c in CAT_FEATURES:
        write_layer(dictionary(p, c), base, "output", f"encoder_{c}")
    out = p
    for c in CAT_FEATURES:
        out = with_codes(out, c, read_layer(spark, base, "output", f"encoder_{c}", "_value string, _code long"))
    return out.select("product_id", "source_store", *ENC_FEATURES)


@query("csv_export", with_products(TOPK_SQL))
def q_csv_export(spark: SparkSession, sf: str) -> DataFrame:
    """The filtered top-k table exported as CSV with header (read back to check)."""
    t = topk_products(processed_products(spark, sf))
    path = layer_path(layer_base(spark), "output", "topk_export")
    csv_export(t, path)
    return spark.read.schema(t.schema).option("header", True).csv(path)


@query("append_ingest", with_raw_ctes(landed_cte() + "\nSELECT * FROM landed"))
def q_append_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Two ingest runs append their stores' rows (partitioned by store); the table is read back."""
    landed = landed_products(spark, sf)
    base = layer_base(spark)
    first = ["store_0", "store_1", "store_2", "store_3", "store_4"]
    append_ingest(landed.filter(F.col("source_store").isin(first)), base)
    append_ingest(landed.filter(~F.col("source_store").isin(first)), base)
    return read_layer(spark, base, "raw", "products", landed.schema).select(*landed.columns)


@query("audit_log_sink", AUDIT_SQL)
def q_audit_log_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Audit rows appended as JSON lines (one append per half of the conversations), read back."""
    a = audit_rows(read_table(spark, sf, "conversations"))
    path = layer_path(layer_base(spark), "output", "agent_audit_log")
    audit_log_sink(a.filter(F.col("conv_id") % 2 == 0), path)
    audit_log_sink(a.filter(F.col("conv_id") % 2 == 1), path)
    return read_audit_log(spark, audit_log_days(spark, path))


@query("audit_log_scan", "WITH a AS (" + AUDIT_SQL + ") SELECT * FROM a ORDER BY ts DESC, conv_id DESC, turn DESC LIMIT 20")
def q_audit_log_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The log with malformed lines mixed in: they are skipped, the last 20 entries kept."""
    a = audit_rows(read_table(spark, sf, "conversations"))
    path = layer_path(layer_base(spark), "output", "agent_audit_log")
    audit_log_sink(a, path)
    for day in audit_log_days(spark, path)[:2]:
        spark.createDataFrame([("{not json",), ("",)], "value string").write.mode("append").text(day)
    return audit_log_scan(spark, path)
