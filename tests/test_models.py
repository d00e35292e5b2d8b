"""DBSCAN grid = brute force; rule metrics consistent with supports."""

import random

from pyspark.sql import functions as F

from vitrine.plans.clustering import dbscan_noise
from vitrine.plans.rules import association_rules, frequent_itemsets


def _brute(points, eps, min_samples):
    n = len(points)
    nb = [sum(1 for q in points if (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 <= eps * eps) for p in points]
    core = [c >= min_samples for c in nb]
    noise = []
    for i, p in enumerate(points):
        near_core = any(core[j] and (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 <= eps * eps for j, q in enumerate(points))
        noise.append(not core[i] and not near_core)
    return core, noise


import pytest


@pytest.mark.parametrize("eps,min_samples,seed", [(0.8, 5, 7), (0.3, 4, 11), (1.5, 8, 3)])
def test_grid_dbscan_equals_brute_force(spark, eps, min_samples, seed):
    random.seed(seed)
    pts = [(round(random.gauss(0, 1), 3), round(random.gauss(0, 1), 3)) for _ in range(150)]
    pts += [(round(random.gauss(3, 0.05), 3), round(random.gauss(3, 0.05), 3)) for _ in range(60)]  # a tight blob
    pts += [(round(random.uniform(-6, 6), 3), round(random.uniform(-6, 6), 3)) for _ in range(40)]
    pts += [(0.5, 0.5)] * 6  # equal points
    df = spark.createDataFrame(pts, "x double, y double")
    got = {(r.x, r.y): (r.is_core, r.is_noise) for r in dbscan_noise(df, eps=eps, min_samples=min_samples).collect()}
    core, noise = _brute(pts, eps, min_samples)
    for p, c, nz in zip(pts, core, noise):
        assert got[p] == (c, nz), p


def test_rules_consistent_with_supports(spark):
    tx = [["a", "b", "c"], ["a", "b"], ["a", "c"], ["b", "c"], ["a", "b", "c", "d"], ["d", "a"]]
    df = spark.createDataFrame([(t,) for t in tx], "items array<string>")
    fi = frequent_itemsets(df, 0.3)
    sup = {tuple(r["items"]): r["support"] for r in fi.collect()}
    for items, s in sup.items():
        assert abs(s - sum(1 for t in tx if set(items) <= set(t)) / len(tx)) < 1e-12
    rules = association_rules(fi).collect()
    assert rules
    for r in rules:
        a, c = tuple(r.antecedents), tuple(r.consequents)
        assert abs(r.confidence - sup[tuple(sorted(a + c))] / sup[a]) < 1e-12
        assert abs(r.lift - r.confidence / sup[c]) < 1e-12
        assert set(a).isdisjoint(c)


def test_region_edges_equal_brute_force(spark):
    import math

    from vitrine.plans.clustering import region_edges

    random.seed(5)
    eps = 0.8
    side = eps / math.sqrt(2.0)
    pts = [(round(random.gauss(0, 1.2), 3), round(random.gauss(0, 1.2), 3)) for _ in range(300)]
    pts = sorted(set(pts))
    cells = [(math.floor(x / side), math.floor(y / side)) for x, y in pts]
    df = spark.createDataFrame([(x, y, cx, cy) for (x, y), (cx, cy) in zip(pts, cells)],
                               "x double, y double, _cx long, _cy long")
    got = {(r.src, r.dst) for r in region_edges(df, eps).collect()}
    exp = set()
    for (p, cp) in zip(pts, cells):
        for (q, cq) in zip(pts, cells):
            if cp != cq and (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 <= eps * eps:
                exp.add((f"{cp[0]}:{cp[1]}", f"{cq[0]}:{cq[1]}"))
    assert got == exp
