import random

import numpy as np
import pytest

from tests.llm import brute
from tests.llm.conftest import make
from vitrine.llm import ngram_join
from vitrine.llm.textarrays import mix
from vitrine.operators.components import components


def _texts(seed, n=160):
    """Families of edited copies: many near the threshold, chains, short texts, copies, a common passage."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [r.choice(vocabulary) for _ in range(30)]
    out = []
    while len(out) < n:
        base = [r.choice(vocabulary) for _ in range(r.choice([3, 4, 6, 9, 25, 60, 150]))]
        if r.random() < 0.4:
            base = passage + base
        for _ in range(r.choice([1, 1, 2, 5, 12])):
            text = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                text[r.randrange(len(text))] = r.choice(vocabulary)
            out.append(" ".join(text))
            if r.random() < 0.5:
                base = text
    return [(i * 3 + 1, t) for i, t in enumerate(out[:n])]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(llm, seed):
    docs = _texts(seed)
    got = {r[0]: (r[1], r[2]) for r in ngram_join.near_duplicates(make(llm, docs)).collect()}
    assert got == brute.components(docs)


def test_rare_and_frequent_classes_find_all_links(llm, monkeypatch):
    monkeypatch.setattr(ngram_join, "RARE", 1)
    docs = _texts(9, 120)
    got = {r[0]: (r[1], r[2]) for r in ngram_join.near_duplicates(make(llm, docs)).collect()}
    assert got == brute.components(docs)


def test_index_keys_meet_for_every_similar_pair():
    """Two sets at or over the threshold share a key, whatever classes their tokens are in."""
    r = np.random.default_rng(0)
    for _ in range(400):
        n = int(r.integers(3, 220))
        universe = mix(r.integers(1, 1 << 60, 2 * n + 10).astype(np.uint64))
        common = int(np.ceil(n * r.uniform(0.76, 1.0)))
        x = np.unique(universe[:n])
        y = np.unique(np.concatenate([universe[:common], universe[n : n + int(r.integers(0, max(1, n // 8 + 1)))]]))
        both = len(np.intersect1d(x, y))
        if 100 * both < 75 * (len(x) + len(y) - both) or len(x) < 3 or len(y) < 3:
            continue
        often = {int(t): int(r.choice([1, 5, 33, 5000])) for t in np.concatenate([x, y])}
        shared = np.intersect1d(x, y)
        keys = []
        for s in (x, y):
            t = np.union1d(shared, s[r.random(len(s)) < 0.5])  # tokens of others that are shared elsewhere
            f = np.array([often[int(v)] for v in t], dtype=np.uint32)
            keys.append((*ngram_join.index_keys(t, len(s), f), int((f > ngram_join.RARE).sum()), len(s)))
        (s1, c1, f1, m), (s2, c2, f2, n2) = keys
        # a combination counts only for pairs that could be linked by their frequent tokens
        assert len(np.intersect1d(s1, s2)) or len(np.intersect1d(c1, c2)) and 175 * min(f1, f2) >= 75 * (m + n2), (n, both)


def test_nulls_ties_and_clashing_columns(llm):
    rows = [(1, None, "a"), (2, "", "b"), (3, " \n\t", "c"), (5, "One two three four five six", "d"), (4, "one TWO three four five six", "e"), (9, "x y", "f"), (8, "x  y\n", "g"), (8, "x  y\n", "g")]
    df = llm.createDataFrame(rows, "doc_id long, text string, owner string").selectExpr("doc_id", "text", "owner", "1 as size", "2 as component", "3 as tokens")
    got = sorted(tuple(r) for r in ngram_join.near_duplicates(df).collect())
    assert got == [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 2, 4), (5, 2, 4), (8, 1, 8), (9, 1, 8)]
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r[0] for r in kept.collect()) == [1, 2, 3, 4, 8, 8]
    assert ngram_join.near_duplicates(df.limit(0)).count() == 0


def test_components_of_a_chain_and_a_star(llm):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {r[0]: r[1] for r in components(llm.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}}


def test_tokens_come_with_exact_numbers_of_owners(llm):
    """Rare tokens are told from frequent ones however many tokens there are; a hot one is so to all its owners."""
    from vitrine.llm import postings

    n, buckets = 6000, 16
    salt = mix(np.arange(1, 3 * n, dtype=np.uint64))

    def post(batch_iter):
        packer = postings.Packer(buckets, mark=1)
        for b in batch_iter:
            for i in b.column("id").to_pylist():
                yield from packer.add(i % n, 4, np.unique(salt[[0, 1 + i % n // 2, n + i % n // 100, 2 * n + i % n // 20]]))
            yield from packer.flush()

    rows = llm.range(0, n + 500, 1, 1).mapInArrow(post, postings.SCHEMA)  # 500 owners come twice
    got = postings.shared_by_owner(rows, buckets, "counted", frequencies=True).collect()
    names = postings.short(salt, buckets)
    assert len(got) == n
    for r in got:
        own = dict(zip(np.frombuffer(r.tokens, dtype=np.uint64).tolist(), r.often))
        want = {0: None, 1 + r.owner // 2: 2, n + r.owner // 100: 100, 2 * n + r.owner // 20: 20}
        assert {k for k in own} == {int(names[i]) for i in want}
        assert all(own[int(names[i])] == c for i, c in want.items() if c)
    codes = {dict(zip(np.frombuffer(r.tokens, dtype=np.uint64).tolist(), r.often))[int(names[0])] for r in got}
    assert len(codes) == 1 and codes.pop() > 128
    steps = postings.frequency_code(np.array([1, 32, 33, 128, 129, 300, 5000, 1 << 40]))
    assert steps.tolist() == sorted(steps.tolist()) and steps[:4].tolist() == [1, 32, 33, 128]
