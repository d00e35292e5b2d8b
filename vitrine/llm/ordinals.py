"""Places of rows in a global or per-group order, without a task that sees a whole group.

Rows are range-partitioned and sorted on (group, order) and written once with their place in the partition.
A group's rows in one partition are one run, so a row's ordinal is the count of the group's rows in
earlier partitions plus its place in the run. What is summed is a row per group and partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.runtime import bucket_count, input_bytes, materialize, parallelism

#: ``monotonically_increasing_id`` holds the partition above this bit and the place in it below.
_BITS = 33


def with_ordinals(df: DataFrame, order: list[Column], group: str | None = None, out: str = "ordinal", size: str | None = None) -> DataFrame:
    """``df`` with ``out``: the row's place (from 0) among its group's rows in the order given, and with
    ``size`` the group's rows. A null group is a group. ``order`` must tell all rows apart (rows that it
    leaves equal get their places in any order). ``df`` is written and read again."""
    keys = ([F.col(group).asc_nulls_first()] if group else []) + order
    known = input_bytes(df) < 1 << 60  # Spark's default for what it can't tell is above
    spread = df.repartitionByRange(bucket_count(df, 64 << 20) if known else parallelism(df.sparkSession), *keys).sortWithinPartitions(*keys)
    stored = materialize(spread.withColumn("_place", F.monotonically_increasing_id()), "ordinals")
    stored = stored.withColumn("_part", F.shiftright("_place", _BITS)).withColumn("_place", F.col("_place").bitwiseAND((1 << _BITS) - 1))
    name = F.col(group) if group else F.lit(0)
    runs = stored.groupBy("_part", name.alias("_group")).agg(F.min("_place").alias("_least"), F.count("*").alias("_n"))
    w = Window.partitionBy("_group").orderBy("_part")
    before = F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    runs = runs.select(F.col("_part").alias("_p"), "_group", (before - F.col("_least")).alias("_shift"), whole.alias("_whole"))
    same = (F.col("_part") == F.col("_p")) & (name.eqNullSafe(F.col("_group")) if group else F.lit(True))
    added = {out: F.col("_place") + F.col("_shift")} | ({size: F.col("_whole")} if size else {})
    joined = stored.join(runs, same)
    return joined.select(*df.columns, *[c.cast("long").alias(n) for n, c in added.items()])
