"""Global ranks, running sums over a value order, per-group top-N and top-k.

A window without ``partitionBy`` runs in one task. Global ranks and running sums are computed
instead over the *distinct* values, split into value buckets whose bounds come from one approximate
quantile sketch (a lazy scalar subquery, no driver round trip): each bucket runs its own window, and
only the per-bucket totals (``n_buckets`` rows) pass through a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

DEFAULT_BUCKETS = 64
#: Ranks are broadcast up to this many distinct values (16 bytes each), beyond it joined by a shuffle.
RANK_BROADCAST_ROWS = 1_000_000


def prefix_sums(vals: DataFrame, value_col: str, weight_cols: list[str], descending: bool = False,
                n_buckets: int = DEFAULT_BUCKETS, inclusive: bool = False, sketch: bool = True) -> DataFrame:
    """For a table with one row per distinct ``value_col``, add ``_before_<w>`` = sum of ``w`` over
    all values strictly earlier in the order (or up to and including the row when ``inclusive``).

    Numeric values are bucketed by approximate quantiles (``sketch``); other values (strings) by
    their two-character prefix, which preserves the order as well.
    """
    v = F.col(value_col)
    if sketch:
        probs = [i / n_buckets for i in range(1, n_buckets)]
        bounds = vals.select(F.percentile_approx(v, probs, 10000).alias("_b")).scalar()
        # Subqueries may not sit inside a lambda: bind the bounds to a column first.
        with_b = (vals.withColumn("_bounds", bounds)
                      .withColumn("_bkt", F.size(F.filter(F.col("_bounds"), lambda b: b < v)))
                      .drop("_bounds"))
    else:
        with_b = vals.withColumn("_bkt", F.substring(v, 1, 2))
    totals = with_b.groupBy("_bkt").agg(*[F.sum(w).alias(f"_tot_{w}") for w in weight_cols])
    b_order = F.col("_bkt").desc() if descending else F.col("_bkt").asc()
    wb = Window.orderBy(b_order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_bkt", *[F.coalesce(F.sum(f"_tot_{w}").over(wb), F.lit(0)).alias(f"_off_{w}")
                                      for w in weight_cols])
    v_order = v.desc() if descending else v.asc()
    upto = Window.currentRow if inclusive else -1
    wi = Window.partitionBy("_bkt").orderBy(v_order).rowsBetween(Window.unboundedPreceding, upto)
    local = with_b.select("*", *[F.coalesce(F.sum(w).over(wi), F.lit(0)).alias(f"_in_{w}") for w in weight_cols])
    # quantile buckets: at most n_buckets rows, a bounded broadcast; prefix buckets: left to AQE.
    joined = local.join(F.broadcast(offsets) if sketch else offsets, "_bkt")
    return joined.select(*vals.columns,
                         *[(F.col(f"_off_{w}") + F.col(f"_in_{w}")).alias(f"_before_{w}") for w in weight_cols])


def rank_min(df: DataFrame, col: str, out: str = "rank", descending: bool = True,
             n_buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """pandas ``rank(method='min')`` over all rows: 1 + number of rows strictly before in the order."""
    counts = materialize(df.groupBy(col).agg(F.count(F.lit(1)).alias("_n")).filter(F.col(col).isNotNull()), "rank-counts")
    ranks = prefix_sums(counts, col, ["_n"], descending, n_buckets)
    ranks = materialize(ranks.select(col, (F.col("_before__n") + 1).cast("long").alias(out)), "ranks")
    # a row per distinct value: broadcast behind a count, so the rows themselves stay where they are
    return df.join(F.broadcast(ranks) if ranks.count() <= RANK_BROADCAST_ROWS else ranks, col, "left")


def top_n_per_group(df: DataFrame, group_cols: list[str], order_cols: list[Column], n_max: int,
                    n_col: str | None = None, rn_col: str | None = None) -> DataFrame:
    """First ``n`` rows per group by ``order_cols`` (which end with a unique key).

    The literal bound ``rn <= n_max`` lets Spark plan a window-group limit that runs before the
    shuffle, so a hot group ships at most ``n_max`` rows per map task.
    """
    w = Window.partitionBy(*group_cols).orderBy(*order_cols)
    rn = rn_col or "_rn"
    out = df.withColumn(rn, F.row_number().over(w)).filter(F.col(rn) <= F.lit(n_max))
    if n_col is not None:
        out = out.filter(F.col(rn) <= F.col(n_col))
    return out if rn_col else out.drop(rn)


def top_k(df: DataFrame, order_cols: list[Column], k: int, rank_col: str | None = None) -> DataFrame:
    """Global top-k (TakeOrderedAndProject: each task keeps k rows, the driver merges k per task),
    then a 1..k rank over the k survivors."""
    head = df.orderBy(*order_cols).limit(k)
    if rank_col is None:
        return head
    w = Window.orderBy(*order_cols)
    return head.withColumn(rank_col, F.row_number().over(w))
