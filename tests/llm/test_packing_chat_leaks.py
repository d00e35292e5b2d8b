import json
import random
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tests.llm.conftest import make
from vitrine.llm import chat_format, decontamination, packing
from vitrine.llm.textarrays import batches


def test_encoder_equals_the_tokenizer():
    r = random.Random(0)
    alphabet = ["a", "b", "é", "ß", " ", " ", "  ", "\n", "\t", " ", " ", "　", "'s", "'", "12", "!", "…", "日本", "<|endoftext|>", "\x1c", "\x85", "\x00", "🙂", ".", ",", "!!", "A", "Zz", "|", "(", "***", "\n", "…."]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(3000)] + ["", " ", "x" * 5000, "a " * 5000]
    whole = Tokenizer.from_file(packing.tokenizer_path())
    encoder = packing.Encoder(packing.tokenizer_path())
    k = 0
    for _, _, w in batches(pa.array(texts), chunk=3000):
        ids, bound = encoder.encode(w.data, w.offsets)
        for i in range(len(w)):
            assert ids[bound[i] : bound[i + 1]].tolist() == whole.encode(texts[k], add_special_tokens=False).ids, repr(texts[k])
            k += 1
    assert k == len(texts)


def test_spaces_at_the_end_do_not_depend_on_the_next_text(tmp_path):
    spec = json.loads(Path(packing.tokenizer_path()).read_text())
    model = spec["model"]
    model["merges"].append(["Ġ", "Ġ"] if isinstance(model["merges"][0], list) else "Ġ Ġ")
    model["vocab"].setdefault("ĠĠ", max([*model["vocab"].values(), *[t["id"] for t in spec["added_tokens"]]]) + 1)
    path = tmp_path / "spaces.json"
    path.write_text(json.dumps(spec))
    whole, encoder = Tokenizer.from_file(str(path)), packing.Encoder(str(path))
    assert len(whole.encode("  ", add_special_tokens=False).ids) == 1
    texts = ["word  ", "next", "word  ", "", "a ", "b", "  ", "x", " ", "y  "]
    for _, _, w in batches(pa.array(texts)):
        ids, bound = encoder.encode(w.data, w.offsets)
        assert [ids[bound[i] : bound[i + 1]].tolist() for i in range(len(w))] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_place_keeps_every_capacity(rule):
    r = np.random.default_rng(5)
    lengths = r.integers(1, 512, 3000)
    for documents, attention in ((512, 512.0**2), (3, 512.0**2), (512, 90_000.0)):
        sequence, offset = packing.place(lengths, (512, documents, attention), rule=rule)
        used = np.bincount(sequence, weights=lengths)
        alone = np.bincount(sequence) == 1
        assert (used <= 512).all() and (np.bincount(sequence) <= documents).all()
        assert (np.bincount(sequence, weights=lengths.astype(float) ** 2)[~alone] <= attention + 1e-6).all()
        for s in np.unique(sequence):
            own = np.flatnonzero(sequence == s)
            own = own[np.argsort(offset[own])]
            assert offset[own].tolist() == np.concatenate([[0], np.cumsum(lengths[own])[:-1]]).tolist()
        if documents == 512 and attention == 512.0**2 and rule == "norm":
            # as few as plain best fit in decreasing order takes
            room = []
            for n in sorted(lengths.tolist(), reverse=True):
                fits = [(r, i) for i, r in enumerate(room) if r >= n]
                if fits:
                    room[min(fits)[1]] -= n
                else:
                    room.append(512 - n)
            assert sequence.max() + 1 <= len(room) + 1


def test_pack_documents(llm):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(["alpha", "beta", "gammas", "é"]) for _ in range(r.choice([0, 1, 5, 40, 300])))) for i in range(120)]
    rows += [(500, None), (501, ""), (7, rows[7][1])]
    df = make(llm, rows).selectExpr("*", "'x' as piece", "1 as length", "2 as block")
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    got = packing.pack_documents(df, tokens=64, with_ids=True).collect()
    whole = {}
    for p in sorted(got, key=lambda p: (p.doc_id, p.piece)):
        ids = np.frombuffer(p.ids, dtype="<u4")
        assert len(ids) == p.length <= 64 and zlib.crc32(p.ids) == p.ids_crc32
        whole.setdefault((p.doc_id, p.piece), (p.start, ids.tolist()))
    for k, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        parts = [v for (d, _), v in sorted(whole.items()) if d == k]
        assert sum((p for _, p in parts), []) == ids
        assert all(len(p) == 64 for _, p in parts[1:]) and (len(parts) == 1) == (len(ids) <= 64)
    sequences = {}
    for p in got:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    total = 0
    for s in sequences.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 64
        total += at
    assert len(sequences) <= np.ceil(total / 64) * 1.05 + 1
    joined = packing.sequences(packing.pack_documents(df, tokens=64, with_ids=True)).collect()
    assert sum(len(r.ids) for r in joined) == 4 * total
    assert packing.pack_documents(df.limit(0)).count() == 0


def _line_path(scores, symbols):
    """Plain Viterbi; the best score."""
    best = {s: scores.step[chat_format.OUTSIDE, s] + scores.emit[s, symbols[0]] for s in range(chat_format.STATES)}
    for x in symbols[1:]:
        best = {s: max(best[a] + scores.step[a, s] for a in best) + scores.emit[s, x] for s in best}
    return max(best.values())


def _score(scores, symbols, states):
    out, before = 0, chat_format.OUTSIDE
    for x, s in zip(symbols, states):
        out += scores.step[before, s] + scores.emit[s, x]
        before = s
    return out


def test_blocks_give_a_best_path():
    r = np.random.default_rng(3)
    scores = chat_format.Scores(r.integers(1, 90, (chat_format.STATES + 1, chat_format.STATES)).astype(float), r.integers(1, 90, (chat_format.STATES, chat_format.SYMBOLS)).astype(float))
    for n in (1, 2, 7, 60, 203):
        symbols = r.integers(0, chat_format.SYMBOLS, n)
        start = np.arange(0, n, 10)
        size = np.diff(np.append(start, n))
        order = np.argsort(-size, kind="stable")
        back = np.argsort(order)
        matrices = chat_format.forward(scores, symbols, start[order], size[order])[back]
        ends = chat_format.fold(matrices)
        states = chat_format.forward(scores, symbols, start[order], size[order], ends[order])
        assert _score(scores, symbols, states) == _line_path(scores, symbols)


def test_transcripts_are_read_back(llm):
    r = random.Random(4)
    rows = []
    for c in range(60):
        for t in range(r.randint(2, 9)):
            role = "system" if t == 0 and c % 5 == 0 else ("user", "assistant")[t % 2]
            n = 1 if role != "assistant" else r.randint(2, 6)
            rows.append((c, t, role, "\n".join(" ".join(["word"] * r.randint(2, 50 if role == "assistant" else 8)) for _ in range(n)) + ("?" if role == "user" else ".")))
    rows += [(900, t, ("user", "assistant")[t % 2], f"turn {t}") for t in range(3000)]
    rows += [(901, 0, "user", None), (902, 0, None, ""), (None, 0, "user", "x"), (903, None, "user", "x")]
    turns = llm.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    lines = chat_format.derived_transcripts(turns).cache()
    scores = chat_format.fit(chat_format.labelled(lines.where(~chat_format.held_out(lines.conv_id))))
    decoded = chat_format.decode(lines.withColumn("block", lines.conv_id), scores, block=64)
    found = {(x.conv_id, x.line_no): x.state for x in decoded.collect()}
    truth = {(x.conv_id, x.line_no): (x.role, x.begins) for x in lines.where(chat_format.held_out(lines.conv_id)).collect()}
    assert len(found) == lines.count()
    right = sum(chat_format.ROLES[found[k] % 3] == role for k, (role, _) in truth.items() if role)
    assert len(truth) > 50 and right >= 0.9 * len(truth)
    messages = chat_format.render(decoded, block=64).where("conv_id = 900").orderBy("first_line").collect()
    assert sum(m.n_lines for m in messages) == 3000 and messages[0].first_line == 0
    assert all(m.message.startswith(f"<|im_start|>{m.role}\n") and m.message.endswith("<|im_end|>") and "Human" not in m.message for m in messages)
    assert chat_format.render(chat_format.decode(lines.limit(0), scores)).count() == 0


ITEMS = [
    (1, "Yesterday Anna walked along the river and met Tom near the mill, then Anna carried 12 kg of flour home for them."),
    (2, "the quick brown fox jumps over the lazy dog and then sleeps under a very tall green tree today"),
    (3, None), (4, ""), (5, "too short"), (2, "the quick brown fox jumps over the lazy dog and then sleeps under a very tall green tree today"),
]


def test_templates_and_slots(llm):
    item1 = ITEMS[0][1]
    rows = [
        (1, "Well. " + item1 + " Fine."),
        (2, "well, anna: " + item1.replace("Anna", "Berta").replace("Tom", "Karl").replace("12 kg", "9.5 lbs")),
        (3, item1.replace("then Anna", "then Eve")),  # Anna has become two people
        (4, "Nothing of the kind. 12 kg of flour."), (5, None), (6, ""),
        (7, "x THE QUICK, brown (fox) jumps over the lazy dog; and then sleeps under a very tall green tree today!"),
        (7, "x THE QUICK, brown (fox) jumps over the lazy dog; and then sleeps under a very tall green tree today!"),
        (None, ITEMS[1][1]), (8, " ".join(ITEMS[1][1].split()[:6])),
    ]
    docs = make(llm, rows).selectExpr("*", "1 as item_id", "2 as coverage", "3 as leaked")
    items = llm.createDataFrame(ITEMS, "item_id long, text string")
    got = sorted(((r.doc_id is None, r.doc_id or 0, list(r.item_ids), r.verbatim) for r in decontamination.report(docs, items).collect()))
    assert got == [
        (False, 1, [1], True), (False, 2, [1], False), (False, 3, [], False), (False, 4, [], False), (False, 5, [], False), (False, 6, [], False),
        (False, 7, [2], True), (False, 7, [2], True), (False, 8, [], False), (True, 0, [2], True),
    ]
    kept = decontamination.remove(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6, 8]
    assert decontamination.report(docs, items.limit(0)).where("contaminated").count() == 0
    assert decontamination.report(docs.limit(0), items).count() == 0


def test_short_dense_and_long_items(llm):
    sentence = [f"word{i}" for i in range(250)]
    kana = "".join(chr(0x3042 + k) for k in range(40))
    items = [
        (1, "What is 12 * 35 + 4 - 17?"), (2, "tall green trees"), (3, " ".join(sentence)), (4, kana), (5, "!!! ..."),
        (6, "Each box holds 3 pears and 5 apples, so how many pieces of fruit does the shop sell in the end?"),
        (7, "1 2 3 4 5 6 7 8 9 10 11 12"), (8, "日本"),
    ]
    rows = [
        (1, "Q: What is 12 * 35 + 4 - 17? A: 407"), (2, "What is 12 * 36 + 4 - 17?"), (3, "two Tall, green trees."), (4, "tall and green trees"),
        (5, "before " + " ".join(sentence[90:190]) + " after"), (6, " ".join(sentence[:15])), (7, f"x {kana[:25]} y"), (8, "とても" + kana + "です"),
        (9, items[5][1].replace("3", "4").replace("5", "4")), (10, "0 1 2 3 4 5 6 7 8 9 10 11 12"), (11, "12 11 10 9 8 7 6 5 4 3 2 1"), (12, "これは日本です"), (13, "!!! ..."),
        (14, " ".join(sentence[90:106])),
    ]
    found = decontamination.find(make(llm, rows), llm.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id): r.verbatim for r in found}
    assert got == {(1, 1): True, (3, 2): True, (5, 3): True, (7, 4): True, (8, 4): True, (9, 6): False, (10, 7): True, (12, 8): True, (14, 3): True}
    cover = {r.doc_id: r.coverage for r in found}
    assert cover[5] == 100 / 250 and cover[1] == cover[3] == cover[8] == 1.0 and cover[14] == 16 / 250


def test_blocks_of_items_change_nothing(llm, monkeypatch):
    r = random.Random(8)
    vocabulary = [f"word{i}" for i in range(60)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(20))) for i in range(12)]
    docs = [(i, " ".join(r.choice(vocabulary) for _ in range(30)) + (" " + items[i % 12][1] if i % 3 == 0 else "")) for i in range(40)]
    d, b = make(llm, docs), llm.createDataFrame(items, "item_id long, text string")
    whole = sorted(tuple(x) for x in decontamination.find(d, b).collect())
    monkeypatch.setattr(decontamination, "BLOCK_CHARS", 300)
    assert sorted(tuple(x) for x in decontamination.find(d, b).collect()) == whole
    assert {(x[0], x[1]) for x in whole} == {(i, i % 12) for i in range(0, 40, 3)}


def brute_matches(known, t, k, cover, least, run):
    """Every alignment of a text and every item, window by window, slots as dictionaries."""
    base, n = int(t.first[k]), int(t.first[k + 1] - t.first[k])
    key, value, kind = (list(x[base : base + n]) for x in (t.key, t.value, t.kind))
    out = set()
    for i, size in enumerate(known.size):
        if not size:
            continue
        wide = min(known.width, size)
        of = lambda j: (known.value[i][j], known.kind[i][j])
        hit, same, long = set(), True, False
        for s in range(-size, n + 1):
            first = []
            for a in range(size - wide + 1):
                if not 0 <= s + a <= n - wide:
                    continue
                pairs = [(of(a + j), (value[s + a + j], kind[s + a + j])) for j in range(wide)]
                equal = all(x[0] == y[0] for x, y in pairs)
                typed = all(x[1] == y[1] and (x[1] > 0 or x[0] == y[0]) for x, y in pairs)
                solid = sum(x[1] == 0 for x, _ in pairs) >= known.literals and sum(y[1] == 0 for _, y in pairs) >= known.literals
                if equal or (wide == known.width and typed and solid):
                    first.append(a)
            if not first or size == 1 and not (t.opens[base + s] and t.ends[base + s]):
                continue
            covered = {a + j for a in first for j in range(wide)}
            slots = [j for j in sorted(covered) if known.kind[i][j] > 0]
            there, back = {}, {}
            for j in slots:
                there.setdefault(of(j), set()).add(value[s + j])
                back.setdefault((value[s + j], known.kind[i][j]), set()).add(known.value[i][j])
            if any(known.value[i][j] != value[s + j] for j in slots):
                bad = {j for j in slots if len(there[of(j)]) > 1}
                if any(known.kind[i][j] == decontamination.NAME for j in bad):
                    covered = set()
                else:
                    bad |= {j for j in slots if len(back[value[s + j], known.kind[i][j]]) > 1}
                    covered = {a + j for a in first if not bad & set(range(a, a + wide)) for j in range(wide)}
                    same = False
            hit |= covered
            for a in range(size - run + 1):
                if all(0 <= s + a + j < n and known.value[i][a + j] == value[s + a + j] for j in range(run)):
                    long = True
                    hit |= set(range(a, a + run))
        if long or len(hit) >= max(cover * size, min(least, size)):
            out.add((k, known.ids[i], len(hit) / size, same))
    return out


@pytest.mark.parametrize("seed", range(12))
def test_alignments_equal_brute_force(seed):
    r = random.Random(seed)
    words = [["a", "b", "3", "4", "Ann", "Bob", "kg", "pear"], ["pear", "pear", "pear", "7"], ["x", "y", "Zed", "1", "2", "und", "the"]][seed % 3]
    line = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [line(r.randint(1, 30)) for _ in range(6)] + ["pear " * 25, "pear", "x " * 18, "1 2 3 " * 8]
    texts = [line(r.randint(0, 60)) for _ in range(6)] + ["pear " * 70, "x x pear\npear\n" + "x " * 40, "1 2 3 " * 20, "q " + items[0] + " q " + items[1].replace("3", "4"), "pear\nx"]
    known = decontamination._Items(list(range(len(items))), items, decontamination.WIDTH, decontamination.LITERALS)
    args = (decontamination.COVER, decontamination.LEAST, decontamination.RUN)
    for _, _, w in decontamination.batches(pa.array(texts, pa.string())):
        t = decontamination.Templates(w)
        start, h, _ = t.fingerprints(known.width, known.literals, known.short)
        hit = np.isin(h, known.hash)
        order = np.argsort(start[hit], kind="stable")
        start, h = start[hit][order], h[hit][order]
        own = np.searchsorted(t.first, start, side="right") - 1
        for k in range(len(texts)):
            got = {(k, *m) for m in known.matches(t, k, start[own == k], h[own == k], *args)} if (own == k).any() else set()
            assert got == brute_matches(known, t, k, *args)


def test_repetitive_text_against_repeated_items(llm):
    """A hundred thousand equal words, and a grid of digits, within seconds."""
    import time

    items = [(i, "pear " * (150 + i)) for i in range(5)] + [(9, "1 2 3 4 5 6 7 8 9 0 " * 20)]
    rows = [(1, "pear " * 100_000), (2, "1 2 3 4 5 6 7 8 9 0 " * 10_000), (3, "no fruit here")]
    began = time.time()
    found = decontamination.find(make(llm, rows), llm.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(1, i) for i in range(5)] + [(2, 9)] and time.time() - began < 30


def test_one_word_item_is_a_whole_line(llm):
    rows = [(1, "She sold pears."), (2, "fruit:\nPears!\nand plums"), (3, "pears")]
    found = decontamination.find(make(llm, rows), llm.createDataFrame([(1, "pears")], "item_id long, text string")).collect()
    assert sorted(r.doc_id for r in found) == [2, 3]
