"""Distributed quantiles equal DuckDB's ``quantile_cont`` (which interpolates as pandas does)."""

import random

import duckdb
import pandas as pd
import pytest

from vitrine.operators.quantiles import exact_quantiles

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


def values(kind, n, rng):
    if kind == "ties":
        return [float(rng.choice([1, 1, 1, 2, 7])) for _ in range(n)]
    if kind == "hot":
        return [0.5 if i % 3 else rng.uniform(-1e6, 1e6) for i in range(n)]
    return [rng.gauss(0, 1) for _ in range(n)]


@pytest.mark.parametrize("kind", ["ties", "hot", "spread"])
@pytest.mark.parametrize("n_buckets", [2, 7, 128])
def test_by_group(spark, kind, n_buckets):
    rng = random.Random(n_buckets)
    rows = [(g, v) for g, n in (("a", 1000), ("b", 3), ("c", 1), (None, 50)) for v in values(kind, n, rng)]
    rows += [("a", None), ("nothing", None)]
    got = {r.g: r.quantiles for r in exact_quantiles(spark.createDataFrame(rows, "g string, v double"), "v", PROBS, ["g"], n_buckets=n_buckets).collect()}
    frame = pd.DataFrame(rows, columns=["g", "v"])  # noqa: F841
    want = duckdb.sql(f"SELECT g, quantile_cont(v::DOUBLE, {PROBS}) FROM frame WHERE v IS NOT NULL GROUP BY g").fetchall()
    assert set(got) == {g for g, _ in want} == {"a", "b", "c", None}
    for g, q in want:
        assert got[g] == pytest.approx(q, rel=1e-15, abs=1e-15)


def test_whole_table_and_empty(spark):
    df = spark.createDataFrame([(i * 37 % 101,) for i in range(101)] + [(None,)], "v int")
    assert exact_quantiles(df, "v", [0.25, 0.5, 0.999]).first().quantiles == pytest.approx([25.0, 50.0, 99.9])
    assert exact_quantiles(df.where("v < 0"), "v", [0.25, 0.5]).first().quantiles == [None, None]
    assert exact_quantiles(df.where("v < 0"), "v", [0.5], ["v"]).collect() == []


def test_no_aggregate_holds_a_group(spark):
    """Values meet in counts by value and in windows by bucket; no aggregation collects a group's values."""
    df = spark.range(5000).selectExpr("id % 3 AS g", "cast(id AS double) AS v")
    plan = exact_quantiles(df, "v", [0.5], ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan and "collect_set" not in plan
    assert plan.count("collect_list(") <= 2  # partial and final, of the ranks that are wanted
