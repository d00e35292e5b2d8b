"""Batched KMeans, silhouette and principal components against plain numpy."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.operators import lloyd as L
from vitrine.operators import moments as M

COLS = ["a", "b", "c"]


def points(n=400, seed=2):
    rng = np.random.default_rng(seed)
    centres = np.array([[0, 0, 0], [4, 4, 0], [-4, 3, 2], [3, -5, 1.0]])
    x = centres[rng.integers(0, 4, n)] + rng.normal(0, 0.8, (n, 3))
    return [(f"k{i}", *np.round(v, 6).tolist()) for i, v in enumerate(x)] + [("twin", 1.0, 1.0, 1.0), ("twin2", 1.0, 1.0, 1.0)]


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "key string, a double, b double, c double").repartition(parts)


def brute_lloyd(rows, k, seed, rounds):
    x = np.array([r[1:] for r in rows])
    order = sorted(range(len(rows)), key=lambda i: hashlib.md5(f"{rows[i][0]}#{seed}".encode()).hexdigest())
    centres = dict(enumerate(x[order[:k]]))
    for _ in range(rounds):
        ids = sorted(centres)
        near = np.array([ids[int(np.argmin([((p - centres[c]) ** 2).sum() for c in ids]))] for p in x])
        centres = {c: np.round(x[near == c].mean(axis=0), 6) for c in ids if (near == c).any()}
    ids = sorted(centres)
    d = np.array([[((p - centres[c]) ** 2).sum() for c in ids] for p in x])
    return centres, d.min(axis=1).sum(), [ids[i] for i in d.argmin(axis=1)]


def brute_silhouette(x, labels):
    out = []
    for i, p in enumerate(x):
        far = np.sqrt(((x - p) ** 2).sum(axis=1))
        own = [j for j in range(len(x)) if labels[j] == labels[i] and j != i]
        others = {c: np.mean([far[j] for j in range(len(x)) if labels[j] == c]) for c in set(labels) if c != labels[i]}
        a, b = (np.mean(far[own]) if own else 0), min(others.values())
        out.append((b - a) / max(a, b) if own else 0.0)
    return float(np.mean(out))


def test_all_runs_equal_their_own_lloyd(spark, monkeypatch):
    rows = points()
    scans = []
    step = L._step
    monkeypatch.setattr(L, "_step", lambda *a: scans.append(1) or step(*a))
    got = L.lloyd(frame(spark, rows), F.col("key"), COLS, [2, 3, 5], [7, 8, 9], 6)
    assert len(scans) <= 7
    for k, own in got.items():
        runs = {s: brute_lloyd(rows, k, s, 6) for s in (7, 8, 9)}
        least = min(runs, key=lambda s: (round(runs[s][1], 3), s))
        assert own.seed == least and abs(own.cost - runs[least][1]) < 2e-3
        for c, centre in runs[least][0].items():
            assert np.allclose(own.centres[c], centre, atol=1e-6)
        labels = {r.key: r.c for r in frame(spark, rows).select("key", L.nearest(COLS, own).alias("c")).collect()}
        assert [labels[r[0]] for r in rows] == runs[least][2]


def test_same_clusters_for_any_partitioning(spark):
    rows = points()
    a, b = (L.lloyd(frame(spark, rows, n), F.col("key"), COLS, [3, 4], [1, 2], 8) for n in (1, 11))
    assert {k: (c.seed, c.centres) for k, c in a.items()} == {k: (c.seed, c.centres) for k, c in b.items()}


def test_few_and_equal_rows(spark):
    one = L.lloyd(frame(spark, [("x", 1.0, 2.0, 3.0)] * 1, 1), F.col("key"), COLS, [3], [1], 3)[3]
    assert list(one.centres.values()) == [(1.0, 2.0, 3.0)]
    same = L.lloyd(frame(spark, [(f"x{i}", 1.0, 2.0, 3.0) for i in range(9)], 2), F.col("key"), COLS, [3], [1], 3)[3]
    assert same.centres == {0: (1.0, 2.0, 3.0)} and same.cost == 0
    assert L.lloyd(frame(spark, points()).where("false"), F.col("key"), COLS, [3], [1], 3) == {}


def test_silhouette_is_exact_over_all_rows_and_close_on_a_sample(spark):
    rows = points(300)
    x = np.array([r[1:] for r in rows])
    clusters = L.lloyd(frame(spark, rows), F.col("key"), COLS, [2, 4], [7], 8)
    df = frame(spark, rows).select("*", *[L.nearest(COLS, c).alias(f"k{k}") for k, c in clusters.items()])
    whole = L.silhouettes(df, F.col("key"), COLS, ["k2", "k4"], 10_000, 1)
    part = L.silhouettes(df, F.col("key"), COLS, ["k2", "k4"], 120, 1)
    for k in (2, 4):
        _, _, labels = brute_lloyd(rows, k, 7, 8)
        want = brute_silhouette(x, labels)
        assert whole[f"k{k}"] == (pytest.approx(want, abs=1e-9), 0.0, len(rows))
        value, error, n = part[f"k{k}"]
        assert n == 120 and error > 0 and abs(value - want) < 4 * error


def test_a_row_alone_counts_nothing(spark):
    df = spark.createDataFrame([("p", 0.0, 0.0, 0.0, 0), ("q", 0.0, 1.0, 0.0, 1), ("r", 0.0, 3.0, 0.0, 1)], "key string, a double, b double, c double, l int")
    value, error, n = L.silhouettes(df, F.col("key"), COLS, ["l"], 10, 1)["l"]
    # q: inside 2, p 1 away; r: inside 2, p 3 away
    assert value == pytest.approx((0 + (1 - 2) / 2 + (3 - 2) / 3) / 3) and (error, n) == (0.0, 3)


def test_components_equal_the_eigenvectors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (500, 5)) @ rng.normal(0, 2, (5, 5)) + 100
    cols = [f"x{i}" for i in range(5)]
    df = spark.createDataFrame(x.tolist(), ", ".join(f"{c} double" for c in cols)).repartition(4)
    means, loadings, variances, total = M.principal_components(df, cols)
    values, vectors = np.linalg.eigh(np.cov(x.T))
    for i, (loading, variance) in enumerate(zip(loadings, variances)):
        want = vectors[:, -1 - i] * np.sign(vectors[np.abs(vectors[:, -1 - i]).argmax(), -1 - i])
        assert np.allclose(loading, want, atol=1e-6) and math.isclose(variance, values[-1 - i], rel_tol=1e-6)
    assert math.isclose(total, values.sum(), rel_tol=1e-6)
    got = np.array([r.p for r in df.select(M.projected(cols, means, loadings[0]).alias("p")).collect()])
    assert math.isclose(got.var(ddof=1), values[-1], rel_tol=1e-6) and abs(got.mean()) < 1e-6


def test_components_of_constant_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0)] * 5, "x double, y double")
    _, loadings, variances, total = M.principal_components(df, ["x", "y"])
    assert total == 0 and variances == [0.0, 0.0] and loadings[0].tolist() == [1.0, 0.0]


def test_matrix_products_decide_as_the_columns_do():
    import numpy as np

    rng = np.random.default_rng(3)
    x = np.concatenate([rng.integers(0, 400, (500, 4)).astype(float), rng.normal(size=(500, 4)) * 1e6])
    centres = np.concatenate([x[rng.integers(0, 1000, 12)], np.repeat(x[:2], 2, axis=0), (x[:3] + x[3:6]) / 2])
    edges = np.array([0, 3, 8, 12, 16, 19])
    found = L._nearest_centres(x, centres, edges)
    far = L._squared(x, centres)
    for i, (a, z) in enumerate(zip(edges[:-1], edges[1:])):
        assert (found[i] == far[:, a:z].argmin(axis=1)).all()
    near = L._distances(x, np.concatenate([x[:50], x[:5] + 1e-7]))
    assert np.allclose(near, np.sqrt(L._squared(x, np.concatenate([x[:50], x[:5] + 1e-7]))), rtol=1e-7, atol=0)


def test_segments_run_their_own_k_only(spark, monkeypatch):
    from vitrine.plans import clustering

    asked = []
    monkeypatch.setattr(clustering, "N_INIT", 1)
    monkeypatch.setattr(clustering, "ROUNDS", 2)
    monkeypatch.setattr(clustering, "lloyd", lambda frame, key, cols, ks, *a: asked.append(ks) or L.lloyd(frame, key, cols, ks, *a))
    clustering._kmeans_clusters(spark, "/root/testdata/sf0.001")
    assert asked == [[clustering.K]]


def test_first_rows_are_those_of_the_least_hashes(spark):
    import hashlib

    rows = points()
    df = frame(spark, rows, 5).withColumn("key", F.when(F.col("key") == rows[0][0], None).otherwise(F.col("key")))
    got = L.first_rows(df, F.col("key"), COLS, [7, 8], 4)
    for s in (7, 8):
        hashes = sorted(rows[1:], key=lambda r: (hashlib.md5(f"{r[0]}#{s}".encode()).hexdigest(), r[0]))
        assert got[s] == [tuple(map(float, r[1:4])) for r in [rows[0], *hashes[:3]]]


def test_silhouettes_scan_the_rows_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(L, "materialize", lambda df, name: written.append(name) or __import__("vitrine.session", fromlist=["x"]).materialize(df, name))
    df = frame(spark, points()).withColumn("l", F.lit(0))
    assert L.silhouettes(df, F.col("key"), COLS, ["l"], 10, 1)["l"][2] == 10 and written == ["silhouette-sums"]


def test_whole_silhouette_measures_all_rows(spark, monkeypatch):
    rows = points(300) + [(f"again{i}", *r[1:]) for i, r in enumerate(points(300)[:40])]
    x = np.array([r[1:] for r in rows])
    clusters = L.lloyd(frame(spark, rows), F.col("key"), COLS, [2, 4], [7], 8)
    df = frame(spark, rows).select("*", *[L.nearest(COLS, c).alias(f"k{k}") for k, c in clusters.items()])
    want = {f"k{k}": pytest.approx(brute_silhouette(x, brute_lloyd(rows, k, 7, 8)[2]), abs=1e-9) for k in (2, 4)}
    assert L.whole_silhouettes(df, COLS, ["k2", "k4"]) == want
    scans, far = [], L._far
    monkeypatch.setattr(L, "MEASURED", 100)
    monkeypatch.setattr(L, "HELD", 40)
    monkeypatch.setattr(L, "_far", lambda blocks, at, n: scans.append(len(at)) or far(blocks, at, n))
    assert L.whole_silhouettes(df, COLS, ["k2", "k4"]) == want and sum(scans) == len({r[1:] for r in rows}) and len(scans) > 1


def test_whole_silhouette_of_rows_alone_and_of_one_cluster(spark):
    df = spark.createDataFrame([("p", 0.0, 0.0, 0.0, 0, 0), ("q", 0.0, 1.0, 0.0, 1, 0), ("r", 0.0, 3.0, 0.0, 1, 0)], "key string, a double, b double, c double, l int, m int")
    assert L.whole_silhouettes(df, COLS, ["l", "m"]) == {"l": pytest.approx((0 + (1 - 2) / 2 + (3 - 2) / 3) / 3), "m": 0.0}
    assert all(math.isnan(v) for v in L.whole_silhouettes(df.where("false"), COLS, ["l"]).values())


def test_k_selection_takes_all_rows(spark, monkeypatch):
    from vitrine import registry
    from vitrine.plans import clustering

    registry.load_all()
    monkeypatch.setattr(clustering, "SILHOUETTE_SAMPLE", 2)
    monkeypatch.setattr(clustering, "N_INIT", 1)
    got = {r.k: r.silhouette for r in registry.QUERIES["k_selection"](spark, "/root/testdata/sf0.001").collect()}
    frame_ = clustering.clustering_frame(spark, "/root/testdata/sf0.001")
    best = clustering.kmeans_best(spark, "/root/testdata/sf0.001")
    rows = frame_.select(*clustering.ALL_FEATURES, L.nearest(clustering.ALL_FEATURES, best[3]).alias("l")).collect()
    assert got[3] == pytest.approx(brute_silhouette(np.array([r[:-1] for r in rows], dtype=float), [r.l for r in rows]), abs=6e-5)
    assert "LIMIT" not in registry.ORACLES["k_selection"].split("lloyd AS")[1].replace("LIMIT 1)", "")
