"""Operators against brute force on small inputs (property style)."""

import random

import pandas as pd
from pyspark.sql import functions as F

from vitrine.operators.dedup import dedup_keep_first
from vitrine.operators.ranking import prefix_sums, rank_min, top_n_per_group


def test_dedup_keep_first_and_idempotent(spark):
    rows = [("a", "s1", 3, "x"), ("a", "s1", 1, "y"), ("a", "s2", 2, "z"), (None, "s1", 5, "n1"), (None, "s1", 4, "n2")]
    df = spark.createDataFrame(rows, "pid string, store string, seq int, v string")
    out = dedup_keep_first(df, ["pid", "store"], ["seq"])
    got = sorted((r.pid or "", r.store, r.seq, r.v) for r in out.collect())
    assert got == [("", "s1", 4, "n2"), ("a", "s1", 1, "y"), ("a", "s2", 2, "z")]
    again = dedup_keep_first(out, ["pid", "store"], ["seq"])
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, out.collect()), key=str)


def test_rank_min_matches_pandas(spark):
    random.seed(1)
    vals = [random.choice([0, 1, 1, 2, 5, 5, 5, 9, 12, 40]) for _ in range(300)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id int, v int")
    got = {r.id: r.rk for r in rank_min(df, "v", "rk", descending=True, n_buckets=4).collect()}
    exp = pd.Series(vals).rank(ascending=False, method="min").astype(int).tolist()
    assert [got[i] for i in range(len(vals))] == exp


def test_prefix_sums_inclusive_and_strings(spark):
    df = spark.createDataFrame([(x, 1) for x in ["b", "a", "ab", "c", "ba"]], "v string, w int")
    got = {r.v: r._before_w for r in prefix_sums(df, "v", ["w"], sketch=False, inclusive=True).collect()}
    assert got == {"a": 1, "ab": 2, "b": 3, "ba": 4, "c": 5}


def test_cap_never_exceeded(spark):
    rows = [(f"s{i % 3}", i, float(i % 7)) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, id int, score double").withColumn(
        "cap", F.when(F.col("g") == "s0", 5).when(F.col("g") == "s1", 50).otherwise(1))
    out = top_n_per_group(df, ["g"], [F.col("score").desc(), F.col("id")], 50, "cap")
    counts = {r.g: r["count"] for r in out.groupBy("g").count().collect()}
    assert counts == {"s0": 5, "s1": 50, "s2": 1}
    best = out.filter("g = 's0'").agg(F.min("score")).first()[0]
    assert best == 6.0


def test_stratified_split_exact_sizes(spark):
    from vitrine.plans.features import stratified_split

    rows = [(f"k{i}", 1 if i % 5 == 0 else 0) for i in range(1000)]
    df = spark.createDataFrame(rows, "key string, topk_label int")
    out = stratified_split(df, F.col("key"), n_buckets=8)
    c = {(r.topk_label, r.split): r["count"] for r in out.groupBy("topk_label", "split").count().collect()}
    assert c[(1, "test")] == 40 and c[(0, "test")] == 160
    assert c[(1, "train")] == 160 and c[(0, "train")] == 640


def test_histogram_bins_and_constant_column(spark):
    from vitrine.plans.bi import histogram

    df = spark.createDataFrame([(float(v),) for v in [0, 1, 2, 3, 4, 10]], "x double")
    got = {r.bin: r["count"] for r in histogram(df, "x", 5).collect()}
    assert got == {0: 2, 1: 2, 2: 1, 4: 1}  # width 2; the maximum falls in the last bin
    const = spark.createDataFrame([(7.0,)] * 4, "x double")
    assert [(r.bin, r["count"]) for r in histogram(const, "x", 5).collect()] == [(0, 4)]


def test_kpis_approx_distinct_matches_exact_on_small_input(spark):
    from vitrine.plans.bi import kpis

    rows = [(f"c{i % 7}", f"b{i % 11}", f"s{i % 3}", 10.0 + i, 4.0, i % 2, True, i % 3 == 0) for i in range(200)]
    df = spark.createDataFrame(rows, "category string, brand string, source_store string, price double, rating double, "
                                     "topk_label int, in_stock boolean, is_on_promo boolean")
    exact = kpis(df).first()
    approx = kpis(df, approx_distinct=True).first()
    assert (exact.n_categories, exact.n_brands, exact.n_sources) == (7, 11, 3)
    assert (approx.n_categories, approx.n_brands, approx.n_sources) == (7, 11, 3)
