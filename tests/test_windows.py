"""Blocked windows equal plain per-entity windows (small blocks force many block edges)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from vitrine.operators.windows import block_window, blocked


def test_blocked_history_and_lead_equal_plain_windows(spark):
    rows = [(c, t, f"m{c}_{t}") for c in range(3) for t in range(0, 23 if c == 0 else 5)]
    df = spark.createDataFrame(rows, "conv long, turn long, text string")
    plain_w = Window.partitionBy("conv").orderBy("turn")
    plain = df.select("conv", "turn",
                      F.array_join(F.collect_list("text").over(plain_w.rowsBetween(-3, -1)), "|").alias("h"),
                      F.lead("text").over(plain_w).alias("nx"))
    b = blocked(df, "turn", before=3, after=1, block=4)
    w = block_window("conv", "turn")
    got = b.select("conv", "turn", "_home",
                   F.array_join(F.collect_list("text").over(w.rowsBetween(-3, -1)), "|").alias("h"),
                   F.lead("text").over(w).alias("nx")).filter("_home").drop("_home")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
