"""Merkle manifest, nearest neighbours and importance resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.llm import importance, merkle, neighbours
from vitrine.llm.ordinals import with_ordinals

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def H(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return H("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def steps(tree, i):
    out = []
    for level in tree[:-1]:
        run = level[i - i % 3 : i - i % 3 + 3]
        out.append((run[: i % 3], run[i % 3 + 1 :]))
        i //= 3
    return out


def manifest(rows):
    """Contract rows of (doc_id, source, lang, n_chars, text) tuples."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
    trees = [levels([leaf_of(r) for r in by[s]]) for s in names]
    top = levels([t[-1][0] for t in trees])
    out = []
    for n, (s, tree) in enumerate(zip(names, trees)):
        for i, r in enumerate(by[s]):
            way = steps(tree, i) + steps(top, n)
            bad = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                bad = (*r[:4], r[4].replace("\n", ""))
            node = leaf_of(bad)
            for left, right in way:
                node = H([*left, node, *right])
            out.append((r[0], leaf_of(r), tree[-1][0], top[-1][0], H(x for a, b in way for x in a + b), node, node == top[-1][0]))
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 26, 27, 28, 243, 100])
def test_log_positions(n):
    """Nodes stand where the closed form says, in completion order."""
    nodes = [str(i) for i in range(n)]
    log = list(merkle.append_log(nodes, merkle.height(n)))
    tree = levels(nodes)
    assert len(log) == sum(map(len, tree))
    for level, own in enumerate(tree):
        for i, node in enumerate(own):
            assert log[merkle.position(level, i, n)] == node
    at = {(level, i): merkle.position(level, i, n) for level, own in enumerate(tree) for i in range(len(own))}
    assert all(at[level, i] < at[level + 1, i // 3] for level, i in at if level < len(tree) - 1)


def test_manifest_equals_plain(llm):
    rng = random.Random(3)
    rows = [(i, "big", "en", 3, f"a\nb {i}") for i in range(800)]
    rows += [(i, "middle", None, None, None if i % 5 else "x\n") for i in range(1000, 1000 + merkle.BLOCK + 1)]
    rows += [(5000, None, "de", 0, ""), (None, "ö", None, None, None), (None, "ö", None, None, "t"), (7, "one", "en", 1, "a\n\nb")]
    rows += [(9, "twice", "en", 1, "a\nb")] * 2 + [(9, "twice", "en", 1, "c"), (11, "", "漢", 1, "漢\n字" * 3000)]
    rng.shuffle(rows)
    df = llm.createDataFrame(rows, DOCS)
    for name in ("grp", "id", "n", "ordinal", "digest", "steps", "block", "_place"):
        df = df.withColumn(name, F.lit("clash"))
    out = merkle.verify(df, tampered=merkle.without_line_feeds())
    got = [tuple(r) for r in out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]
    order = lambda r: (str(r[0]), *map(str, r[1:]))
    assert sorted(got, key=order) == sorted(manifest(rows), key=order)
    assert {r[6] for r in got} == {True, False}


def test_manifest_without_tampering_and_empty(llm):
    df = llm.createDataFrame([(1, "s", None, 1, "a"), (2, "t", None, 1, "b")], DOCS)
    assert [r.verified for r in merkle.verify(df).collect()] == [True, True]
    assert merkle.verify(df.where("false"), tampered=merkle.without_line_feeds()).collect() == []


def test_ordinals_by_group(llm):
    rows = [(None if i % 3 == 0 else f"g{i % 2}", i * 7919 % 1000) for i in range(1000)]
    out = with_ordinals(llm.createDataFrame(rows, "g string, v long"), [F.col("v").asc()], group="g", size="n").collect()
    groups = {}
    for g, v in rows:
        groups.setdefault(g, []).append(v)
    assert len(out) == 1000
    for r in out:
        assert sorted(groups[r.g])[r.ordinal] == r.v and r.n == len(groups[r.g])


def brute_nearest(rows, k, asked):
    own = [(i, np.array(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, dtype=float)).all() and np.any(v)]
    own = list({(i, tuple(v)): (i, v) for i, v in own}.values())
    out = {}
    for q, v in own:
        if asked(q):
            d = sorted((math.sqrt(((v - w) ** 2).sum()), i) for i, w in own if i != q or w is not v)
            out.setdefault(q, []).append(d[:k])
    return out


def test_neighbours_defined_cases(llm):
    """Small tables are searched whole: one block, every point within reach of a sure test."""
    hot = [1.0, 0.0, 2.0]
    rows = [(i, hot) for i in range(0, 400)] + [(500 + i, [float(i), 1.0, -1.0]) for i in range(30)]
    rows += [(600, None), (700, [0.0, 0.0, 0.0]), (800, [1.0, None, 1.0]), (900, [float("nan"), 1.0, 1.0]), (1000, [float("inf"), 1.0, 1.0]), (1100, []), (1200, [1.0]), (None, hot)]
    rows += [(100, hot), (1300, [5.0, 1.0, 1.0]), (1300, [6.0, 1.0, 1.0]), (-100, [-0.0, 3.0, 1.0])]
    df = llm.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("query", F.lit("clash")).withColumn("id", F.lit(1))
    out = neighbours.nearest(df, lambda i: i % 100 == 0, sure=1 - 1e-9)
    got = {}
    for r in out.orderBy("query_id", "rank", "score").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    want = brute_nearest([r for r in rows if r[0] is None or r[0] != 1200], 10, lambda i: i % 100 == 0)
    assert set(got) == set(want)
    for q, each in want.items():
        flat = sorted(x for d in each for x in d)
        assert [i for _, i in sorted(got[q])] == [i for _, i in flat]
        assert np.allclose([d for d, _ in sorted(got[q])], [d for d, _ in flat])
    assert neighbours.nearest(df.where("false"), lambda i: i % 100 == 0).collect() == []
    few = neighbours.nearest(df.where("vec_id in (0, 501, 502)"), lambda i: i % 100 == 0).collect()
    assert sorted((r["rank"], r.vec_id) for r in few) == [(1, 501), (2, 502)]


def test_neighbours_recall_over_many_cells(llm, monkeypatch):
    for name, value in (("BLOCK", 100), ("MAX_CELLS", 8), ("SAMPLE", 300), ("LEAF", 8), ("PACK", 3)):
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(5)
    base = rng.standard_normal((20, 40))
    data = base[rng.integers(0, 20, 3000)] + 0.3 * rng.standard_normal((3000, 40))
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    out = neighbours.nearest(llm.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 100 == 0).collect()
    found = {}
    for r in out:
        found.setdefault(r.query_id, {})[r.vec_id] = r.score
    want = brute_nearest(rows, 10, lambda i: i % 100 == 0)
    hits = sum(len({i for _, i in d[0]} & set(found[q])) for q, d in want.items())
    assert hits >= 0.95 * 300 and len(out) == 300
    for q, own in found.items():
        assert all(abs(s - np.linalg.norm(data[q] - data[i])) < 1e-9 for i, s in own.items())


def test_chi_square_quantile():
    for p, k, x in ((0.95, 1, 3.841458821), (0.95, 12, 21.02606982), (0.99, 8, 20.09023503), (0.5, 2, 2 * math.log(2))):
        assert abs(neighbours.chi_square_quantile(p, k) - x) < 1e-6


def words_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute_importance(rows, target):
    def buckets(text):
        w = words_of(text)
        return len(w), [zlib.crc32(x.encode()) % 10000 for x in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]

    s, t = [0] * 10000, [0] * 10000
    for counts, texts in ((s, [x for _, x in rows]), (t, target)):
        for x in texts:
            for b in buckets(x)[1]:
                counts[b] += 1
    S, T = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((b + 1) * (S + 10000) / ((a + 1) * (T + 10000)))) for a, b in zip(s, t)]
    out = []
    for i, text in rows:
        n, own = buckets(text)
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        h = int(H([f"7:{i}"])[:8], 16)
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(fit[: 25 * len(fit) // 100]):
        r[4] = k + 1
    return out


def test_importance_equals_plain(llm):
    rng = random.Random(8)
    vocabulary = ["Alpha", "beta", "漢字", "Ünïcode", "x1", "9", "e" * 60, "GAMMA"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", "\n", "-", ", ", "\x7f", "_"]) for _ in range(n))
    rows = [(i, text(rng.randint(0, 60))) for i in range(500)] + [(1000, None), (1001, ""), (1002, " .,-"), (1003, text(20000)), (1004, "word"), (-5, text(30))]
    target = [text(10) for _ in range(20)] + [None, "", "beta beta 9 9"]
    docs = llm.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("row", F.lit(1)).withColumn("bucket", F.lit(2))
    out = importance.resample(docs, llm.createDataFrame([(t,) for t in target], "text string"))
    got = sorted(list(r) for r in out.select("doc_id", "n_features", "weight", "score", "rank", "n_words").collect())
    assert got == sorted(brute_importance(rows, target))


def test_importance_repeats_nulls_and_empty(llm):
    long = "one two three four five " * 5
    rows = [(4, long)] * 9 + [(None, long), (5, "short")]
    docs = llm.createDataFrame(rows, "doc_id long, text string")
    out = importance.resample(docs, docs.where("false").select("text"), percent=50).collect()
    assert len(out) == 11 and sorted(r["rank"] for r in out if r["rank"]) == [1, 2, 3, 4, 5]
    assert importance.resample(docs.where("false"), docs.select("text")).collect() == []
    none = importance.resample(docs, docs.select("text"), percent=5).collect()
    assert all(r["rank"] is None for r in none)


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_cutoff_is_exact(llm, n):
    rng = random.Random(n)
    keys = [(rng.randint(-3, 3), rng.randint(0, 5), i) for i in range(n)]
    df = llm.createDataFrame(keys, "score long, tie long, row long").repartition(5)
    order = sorted(keys, key=lambda x: (-x[0], x[1], x[2]))
    for k in sorted({1, n // 2 or 1, n}):
        assert importance.cutoff(df, k) == order[k - 1]
    assert importance.cutoff(df, 0) is None
