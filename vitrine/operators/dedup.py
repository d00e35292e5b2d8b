"""Keep-first de-duplication.

``dedup_keep_first`` is a grouped ``min`` over a struct that starts with the ingest-order columns, not
a ``row_number`` window: the aggregate combines map-side, so a key holding a third of all rows is
collapsed on every mapper before the shuffle instead of landing whole in one window task.
Null keys form a group of their own, as in pandas' ``drop_duplicates``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedup_keep_first(df: DataFrame, keys: list[str], order_cols: list[str]) -> DataFrame:
    """One row per ``keys``: the row that comes first by ``order_cols`` (which should be unique)."""
    order_cols = [c for c in order_cols if c not in keys]  # a key is the same in all rows of its group
    rest = [c for c in df.columns if c not in keys and c not in order_cols]
    packed = F.min(F.struct(*[F.col(c) for c in order_cols], *[F.col(c) for c in rest])).alias("_first")
    out = df.groupBy(*keys).agg(packed)
    return out.select(*[F.col(k) for k in keys], *[F.col(f"_first.{c}").alias(c) for c in order_cols + rest]) \
              .select(*df.columns)


def distinct_values(df: DataFrame, col: str):
    """Number of distinct non-null values as a scalar: the column alone is read and its values collapse before they
    are counted, so rows aren't multiplied as by several distinct counts in one aggregate."""
    return df.select(col).where(F.col(col).isNotNull()).distinct().agg(F.count(F.lit(1))).scalar()


def duplicates_by(df: DataFrame, by: str, col: str, out: str) -> DataFrame:
    """(by, out): rows beyond the first per value of ``col`` (null is one) in each group; (group, value) pairs collapse
    first, so a hot group's values meet in many tasks."""
    pairs = df.groupBy(by, col).agg(F.count(F.lit(1)).alias("_n"))
    return pairs.groupBy(by).agg(F.sum(F.col("_n") - 1).alias(out))


def duplicate_count(df: DataFrame, keys: list[str]):
    """Rows beyond the first per key: count(*) - number of distinct keys (null is a key of its own)."""
    return df.groupBy(*keys).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n_dup"))
