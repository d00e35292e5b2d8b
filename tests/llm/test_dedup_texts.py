import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import brute
from tests.llm.conftest import make
from vitrine.llm import line_dedup, substring_dedup
from vitrine.llm.textarrays import batches, joined, windows


def _docs(seed, n=60):
    r = random.Random(seed)
    vocabulary = [f"v{i}é" for i in range(120)]
    long = [[r.choice(vocabulary) for _ in range(r.choice([49, 50, 51, 70, 140]))] for _ in range(6)]
    lines = [" ".join(r.choice(vocabulary) for _ in range(r.randint(1, 6))) for _ in range(25)]
    out = []
    for i in range(n):
        parts = []
        for _ in range(r.randint(0, 5)):
            kind = r.random()
            if kind < 0.35:
                parts.append(" ".join(r.choice(long)))
            elif kind < 0.5:
                parts.append(" ".join([r.choice(vocabulary)] * r.choice([20, 60, 130])))  # one long run
            elif kind < 0.6:
                parts.append(" ".join(vocabulary[:2] * r.choice([15, 40, 70])))  # a period of two
            elif kind < 0.8:
                parts.append("\n".join(r.choice(lines) for _ in range(r.randint(1, 8))))
            else:
                parts.append("\t".join(r.choice(vocabulary) for _ in range(r.randint(1, 90))))
        out.append((1000 - 7 * i, r.choice([" ", "\n", "\n\n"]).join(parts)))
    out += [(2001, None), (2002, ""), (2003, " \n \r\n")]
    out += [(2004 + k, out[k][1]) for k in range(3)]
    return out


@pytest.mark.parametrize("seed", [4, 5])
def test_substring_dedup_equals_brute_force(llm, seed):
    docs = _docs(seed)
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substring_dedup.dedup(make(llm, docs)).collect()}
    want = {k: (n, n - len(kept), " ".join(kept)) for k, (n, kept) in brute.substring_dedup(docs).items()}
    assert got == want
    assert sum(v[1] for v in want.values()) > 1000


def test_equal_windows_have_equal_anchors():
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(9)]
    texts = []
    shared = [r.choice(vocabulary) for _ in range(90)] + ["w1"] * 70 + ["w1", "w2"] * 40
    for _ in range(30):
        texts.append(" ".join([r.choice(vocabulary) for _ in range(r.randint(0, 30))] + shared + [r.choice(vocabulary) for _ in range(r.randint(0, 30))]))
    seen = {}
    for _, _, w in batches(pa.array(texts), chunk=4000):
        start, key = substring_dedup.anchors(w)
        whole = windows(w.hashes(), 50)[start]
        for h, k in zip(whole.tolist(), key.tolist()):
            assert seen.setdefault(h, k) == k


@pytest.mark.parametrize("seed", [6])
def test_line_dedup_equals_brute_force(llm, seed):
    docs = _docs(seed)
    df = make(llm, docs).selectExpr("doc_id", "text", "length(text) as n_chars", "'x' as starts", "1 as run")
    want = brute.line_dedup(docs)
    got = {r.doc_id: r.text for r in line_dedup.dedup(df).collect()}
    assert got == {k: v for k, v in want.items()}
    cleaned = line_dedup.clean(df)
    assert cleaned.columns == df.columns
    rows = {r.doc_id: (r.text, r.n_chars) for r in cleaned.collect()}
    assert rows == {k: ((None, None) if t is None else (want[k], len(want[k]))) for k, t in docs}


def test_heavy_lines_go_without_a_run_of_three(llm):
    long = " ".join(f"w{i}" for i in range(20))
    half = [" ".join(f"{c}{i}" for i in range(10)) for c in "ab"]
    kana = "あ" * 80
    rows = [
        (1, f"one\n{long}\ntwo\nshort line"), (2, f"three\n{long}\nfour\nshort line"), (3, long), (4, "\n".join(half)), (5, "\n \n".join(["five", *half, "six"])),
        (6, half[0]), (7, kana), (8, f"seven\n{kana}"), (9, f"{half[1]}\n{half[0]}"), (10, f"{long}\neight"), (11, f"{long}\neight"), (12, None), (13, f"nine\n{long}\n{long}"),
    ]
    df = make(llm, rows)
    got = {r.doc_id: r.text for r in line_dedup.clean(df, least=20).collect()}
    assert got == dict(rows) | {2: "three\nfour\nshort line", 3: "", 5: "five\n \n \n \nsix", 8: "seven", 10: "eight", 11: "", 13: "nine"}
    assert {r.doc_id: r.n_removed for r in line_dedup.dedup(df, least=20).collect()} == {1: 0, 2: 1, 3: 1, 4: 0, 5: 2, 6: 0, 7: 0, 8: 1, 9: 0, 10: 1, 11: 2, 12: 0, 13: 2}
    assert {r.doc_id: r.text for r in line_dedup.dedup(df).collect()} == {k: t or "" for k, t in rows}


def test_winnowing_guarantees_a_shared_line():
    r = np.random.default_rng(1)
    h = r.integers(0, 6, 400).astype(np.uint64)
    chosen = line_dedup.winnow(h, 3)
    assert len(chosen) == 398 and (chosen >= np.arange(398)).all() and (chosen < np.arange(398) + 3).all()
    by_window = {}
    for p, c in enumerate(chosen):
        assert by_window.setdefault(tuple(h[p : p + 3]), c - p) == c - p


def test_repeated_rows_null_ids_and_empty_tables(llm):
    text = "\n".join(f"line number {i}" for i in range(6))
    long = " ".join(f"w{i}" for i in range(60))
    df = llm.createDataFrame([(1, text), (1, text), (None, text), (2, text)], "doc_id long, text string")
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in line_dedup.dedup(df).collect()))
    assert got == [(False, 1, 0), (False, 1, 0), (False, 2, 6), (True, 0, 0)]
    df = llm.createDataFrame([(1, long), (1, long), (None, long), (2, long)], "doc_id long, text string")
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in substring_dedup.dedup(df).collect()))
    assert got == [(False, 1, 0), (False, 1, 0), (False, 2, 60), (True, 0, 0)]
    assert line_dedup.dedup(df.limit(0)).count() == 0 and substring_dedup.dedup(df.limit(0)).count() == 0


def test_joined_words():
    texts = ["a  b\tc", "", None, " x ", "é ü\n\nß"]
    out = []
    for _, _, w in batches(pa.array(texts), chunk=4):
        keep = np.ones(len(w.start), dtype=bool)
        keep[1::2] = False
        out += joined(w, keep).to_pylist()
    assert out == ["a c", "", "", "x", "é ß"]


def test_clean_keeps_any_column_name_and_drops_emptied_texts(llm):
    rows = [(1, "a b c\nd e f\ng h i\nk"), (2, "a b c\nd e f\ng h i"), (3, ""), (4, None), (5, " \n")]
    docs = llm.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 AS __line_dedup_id", "8 AS __line_dedup_starts")
    out = line_dedup.clean(docs)
    assert out.columns == ["doc_id", "text", "__line_dedup_id", "__line_dedup_starts"]
    assert {r.doc_id: r.text for r in out.collect()} == {1: rows[0][1], 2: "", 3: "", 4: None, 5: " \n"}
    assert {r.doc_id for r in line_dedup.clean(docs, emptied=False).collect()} == {1, 3, 4, 5}


def test_filters_keep_any_column_name(llm):
    from vitrine.llm import decontamination, ngram_join, quality_rules

    text = "one two three four five six seven eight nine ten eleven twelve"
    docs = llm.createDataFrame([(1, text), (2, text), (3, "short")], "doc_id long, text string").selectExpr("*", "1 AS __rejected", "2 AS __dropped", "3 AS __leaked")
    assert sorted(r.doc_id for r in ngram_join.keep_one(docs).collect()) == [1, 3]
    items = llm.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    assert sorted(r.doc_id for r in decontamination.remove(docs, items).collect()) == [3]
    assert quality_rules.keep(docs, llm.createDataFrame([(1,)], "doc_id long")).columns == docs.columns
