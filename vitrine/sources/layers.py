"""Layered storage: ``<base>/{raw,processed,output}/<table>`` as parquet (CSV and JSON as options),
JSON result documents, model persistence, CSV export, per-source append and the audit log (2.1).

The base folder is the shared checkpoint folder of the session (``spark.checkpoint.dir``), so every
executor sees it and a retried task rewrites its own part files only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import tables_root

LAYERS = ("raw", "processed", "output")


def layer_base(spark: SparkSession, run_id: str | None = None) -> str:
    """A folder for one run's layers under the application's own root (``drop_tables`` removes it)."""
    return f"{tables_root(spark)}/layers/{run_id or uuid.uuid4().hex}"


def layer_path(base: str, layer: str, name: str) -> str:
    if layer not in LAYERS:
        raise ValueError(f"unknown layer {layer}")
    return f"{base}/{layer}/{name}"


def write_layer(df: DataFrame, base: str, layer: str, name: str, fmt: str = "parquet",
                partition_by: list[str] | None = None, mode: str = "overwrite") -> str:
    path = layer_path(base, layer, name)
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        w.parquet(path)
    return path


def read_layer(spark: SparkSession, base: str, layer: str, name: str, schema: StructType | str | None = None,
               fmt: str = "parquet") -> DataFrame:
    """Read a table with an explicit schema (never inferred for CSV / JSON)."""
    path = layer_path(base, layer, name)
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    if fmt == "csv":
        return r.option("header", True).csv(path)
    if fmt == "json":
        return r.json(path)
    return r.parquet(path)


def write_json_result(df: DataFrame, base: str, name: str) -> str:
    """Result document(s) as JSON text lines (one document per row)."""
    path = layer_path(base, "output", name)
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)
    return path


def read_json_result(spark: SparkSession, base: str, name: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(layer_path(base, "output", name))


def csv_export(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def append_ingest(df: DataFrame, base: str, name: str = "products") -> str:
    """Per-source append: only the new rows are written (partitioned by store), O(new) per run."""
    return write_layer(df, base, "raw", name, partition_by=["source_store"], mode="append")


def audit_log_sink(df: DataFrame, path: str) -> str:
    """Append entries as JSON lines, in a folder per day."""
    df.withColumn("day", F.substring("ts", 1, 10)).write.mode("append").partitionBy("day").json(path)
    return path


AUDIT_SCHEMA = "conv_id long, turn long, ts string, agent string, question string, question_head string, in_scope boolean, response_len int, refused boolean"


def audit_log_days(spark: SparkSession, path: str) -> list[str]:
    """The log's day folders, the newest first."""
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return []
    return sorted((s.getPath().toString() for s in fs.listStatus(top) if s.getPath().getName().startswith("day=")), reverse=True)


def read_audit_log(spark: SparkSession, days: list[str]) -> DataFrame:
    """Entries of the given day folders, malformed lines skipped."""
    if not days:
        return spark.createDataFrame([], AUDIT_SCHEMA)
    return spark.read.schema(AUDIT_SCHEMA).option("mode", "DROPMALFORMED").json(days)


def audit_log_scan(spark: SparkSession, path: str, n: int = 20) -> DataFrame:
    """The last ``n`` entries: the newest day is read, and twice as many days as long as entries are lacking."""
    days, taken = audit_log_days(spark, path), 1
    while taken < len(days) and read_audit_log(spark, days[:taken]).limit(n).count() < n:
        taken *= 2
    log = read_audit_log(spark, days[:taken])
    return log.orderBy(F.col("ts").desc(), F.col("conv_id").desc(), F.col("turn").desc()).limit(n)
