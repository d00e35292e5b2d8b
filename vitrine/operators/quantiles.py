"""Exact interpolated quantiles without a buffer that holds a group's values.

Spark's ``percentile`` keeps every distinct value of a group in one aggregation buffer. Here the distinct values are
counted (map-side combined), cut into buckets at approximate quantiles (a sketch of fixed size a group), and
bucket counts are summed up to ranks. Only the buckets that hold a wanted rank are opened: their values pass
through a sorted window per bucket, which can spill, and the quantile is interpolated between its two ranks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Buckets a group; one holds about this share of the group's distinct values.
N_BUCKETS = 128
_ACCURACY = 10_000


def _same(by: list[str], right: str) -> Column:
    """Null-safe equality of the group columns with those named ``right`` + place."""
    out = F.lit(True)
    for i, c in enumerate(by):
        out = out & F.col(c).eqNullSafe(F.col(f"{right}{i}"))
    return out


def exact_quantiles(df: DataFrame, value: str, probs: list[float], by: list[str] | None = None, out: str = "quantiles",
                    n_buckets: int = N_BUCKETS) -> DataFrame:
    """One row per group: ``by``, ``out`` (the quantile of each of ``probs``, linear between ranks as in
    ``quantile_cont``). Null values don't count; a group without others has no row, but without ``by`` there is
    always one row. A null group is a group."""
    by = list(by or [])
    keys = [F.col(c).alias(f"_g{i}") for i, c in enumerate(by)]
    names = [f"_g{i}" for i in range(len(by))]
    v = F.col(value).cast("double")
    counts = df.select(*keys, v.alias("_v")).where(F.col("_v").isNotNull()).groupBy(*names, "_v").agg(F.count(F.lit(1)).alias("_n"))
    counts = materialize(counts, "quantile-values")

    sketch = F.percentile_approx("_v", [i / n_buckets for i in range(1, n_buckets)], _ACCURACY)
    if by:
        bounds = counts.groupBy(*names).agg(sketch.alias("_bounds"))
        bounds = bounds.select(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(names)], "_bounds")
        bucketed = counts.join(bounds, _same(names, "_b")).drop(*[f"_b{i}" for i in range(len(by))])
    else:
        bucketed = counts.withColumn("_bounds", counts.select(sketch).scalar())
    bucketed = bucketed.withColumn("_bucket", F.size(F.filter("_bounds", lambda b: b < F.col("_v")))).drop("_bounds")

    # a group's buckets, N_BUCKETS rows at most
    whole, upto = Window.partitionBy(*names), Window.partitionBy(*names).orderBy("_bucket")
    totals = bucketed.groupBy(*names, "_bucket").agg(F.sum("_n").alias("_rows"))
    totals = totals.select(*names, "_bucket", "_rows", F.sum("_rows").over(whole).alias("_all"),
                           (F.sum("_rows").over(upto.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_rows")).alias("_before"))
    place = [(F.col("_all") - 1) * F.lit(float(p)) for p in probs]
    ranks = F.array_distinct(F.array(*[f(x).cast("long") for x in place for f in (F.floor, F.ceil)]))
    inside = F.filter(ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_rows")))
    opened = totals.withColumn("_ranks", inside).where(F.size("_ranks") > 0)
    opened = opened.select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate([*names, "_bucket"])], "_all", "_before", "_ranks")

    rows = bucketed.join(opened, _same([*names, "_bucket"], "_o"))
    order = Window.partitionBy(*names, "_bucket").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_last", F.col("_before") + F.sum("_n").over(order))
    held = F.filter("_ranks", lambda r: (r < F.col("_last")) & (r >= F.col("_last") - F.col("_n")))
    found = rows.select(*names, "_all", "_v", F.explode(held).alias("_rank"))
    found = found.groupBy(*names).agg(F.first("_all").alias("_all"), F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"))

    def quantile(p: float) -> Column:
        x = (F.col("_all") - 1) * F.lit(float(p))
        lo, hi = F.floor(x).cast("long"), F.ceil(x).cast("long")
        at = lambda r: F.element_at("_at", r)
        return F.when(lo == hi, at(lo)).otherwise((hi - x) * at(lo) + (x - lo) * at(hi))

    result = found.select(*[F.col(c).alias(b) for c, b in zip(names, by)], F.array(*[quantile(p) for p in probs]).alias(out))
    if by:
        return result
    # without groups also for no values: one row of nulls
    empty = F.array(*[F.lit(None).cast("double") for _ in probs])
    return result.agg(F.coalesce(F.first(out), empty).alias(out))
