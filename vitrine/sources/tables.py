"""Readers for the shared parquet tables.

``spark.read.parquet`` is lazy: Catalyst prunes columns and pushes filters into the scan, so the
readers never select columns themselves.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy parquet scan; its splits follow ``spark.sql.files.maxPartitionBytes``."""
    return spark.read.parquet(table_path(sf_dir, name))
