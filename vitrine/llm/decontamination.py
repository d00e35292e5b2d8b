"""Benchmark decontamination: template windows, hash-joined, with a check that the slots agree.

Words lose the punctuation at their ends and their case; numbers, names and units become typed
placeholders (NUM, NAME, UNIT, and QTY for a number with its unit attached). The rest is literal. Words
of punctuation only leave no token; letters of scripts without spaces are a token each. Windows of ``WIDTH`` tokens
with at least ``LITERALS`` literals are joined on their hash between benchmark items and texts. So are, with all
slot values as literals, the verbatim windows of ``WIDTH`` tokens (the whole item, where it is shorter), which
find spans with too few literals and short items. The windows that match along one alignment of a text and
an item give the matched tokens; in these every slot value of the item has to stand for one value of the
text and the other way round (per type), so "Ann has 3 pears ... Ann" matches "Bob has 5 pears ... Bob"
and not "Bob has 5 pears ... Eve". An alignment in which a name stands for two counts for nothing; other slots that
disagree take the windows around them out. A text is contaminated by an item when the agreeing alignments
cover at least ``COVER`` of the item's tokens, and ``LEAST`` tokens (or all), or when it holds ``RUN`` consecutive
tokens of the item verbatim, whatever their share.

An item of one token has to be a whole line of the text.

* number: starts with a digit and holds digits and ``. , : / -`` only; QTY: starts with a digit otherwise;
* unit: one of ``UNITS`` right behind a number;
* name: a capital followed by a small letter, not at the start of a text, line or sentence, or there if the
  same word is a name elsewhere in its text.

Defined cases: null and empty texts are clean; items without a token (null, empty, punctuation only) match
nothing; an item of fewer than ``WIDTH`` tokens matches as a whole, verbatim, one of a single token only where it is a whole line; equal rows give equal rows; a null id is a document like others; an
empty benchmark leaves every document clean; extra columns are ignored by ``find`` and kept by ``remove``.

Scale: items are taken in blocks of ``BLOCK_CHARS`` characters (each collected, packed in sorted arrays and
broadcast, so of bounded size); each block is one scan of the texts without a shuffle of them. Only matches
are shuffled. A repetitive text has few different surroundings, and of equal ones a text and an item meet once: a
text of one word a hundred thousand times costs little more than its scan.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.runtime import free_name, materialize, with_text
from vitrine.llm.textarrays import _LOWER, Words, batches, hash_spans, mix, ranges, windows

WIDTH = 5
LITERALS = 3
COVER = 0.5
LEAST = 8
RUN = 16
BLOCK_CHARS = 4_000_000
#: Units of measure, money and time (lower case).
UNITS = (
    "percent kg g mg km m cm mm mi mile miles ft feet foot in inch inches lb lbs oz l ml liter liters litre litres gallon gallons "
    "km/h mph kph m/s s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "usd eur gbp dollar dollars euro euros pound pounds cent cents kb mb gb tb hz khz mhz ghz w kw kwh v a c f k degrees"
).split()
NUM, NAME, UNIT, QTY = 1, 2, 3, 4

_TYPE = mix(np.arange(11, 16, dtype=np.uint64))
_CORE = np.ones(256, dtype=bool)
_CORE[:128] = [chr(i).isalnum() for i in range(128)]
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_NUMERIC = _DIGIT.copy()
_NUMERIC[[ord(c) for c in ".,:/-"]] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".!?:"]] = True
_SMALL = np.zeros(256, dtype=bool)  # small ASCII letters and lead bytes of other letters
_SMALL[97:123] = True
_SMALL[0xC3:] = True
_LEAD = np.zeros(256, dtype=bool)  # lead bytes of UTF-8
_LEAD[:0x80] = _LEAD[0xC0:] = True
_BITS = 1 << 22


def _hash_word(word: str) -> np.ndarray:
    raw = np.frombuffer(word.encode(), dtype=np.uint8)
    return hash_spans(raw, np.array([0]), np.array([len(raw)]))


_UNIT_HASHES = np.sort(np.concatenate([_hash_word(u) for u in UNITS]))


def _member(x: np.ndarray, values: np.ndarray) -> np.ndarray:
    """``np.isin`` for a short sorted ``values``."""
    if not len(values):
        return np.zeros(len(x), dtype=bool)
    at = np.minimum(np.searchsorted(values, x), len(values) - 1)
    return values[at] == x


def _unspaced(data: np.ndarray) -> np.ndarray:
    """Places of the characters of scripts written without spaces (Thai to Myanmar, Khmer, Chinese, Japanese)."""
    at = np.flatnonzero(data[:-1] >= 0xE0) if len(data) else np.zeros(0, dtype=np.int64)
    a, b = data[at], data[at + 1]
    thai = (a == 0xE0) & (b >= 0xB8) & (b <= 0xBB)
    myanmar = (a == 0xE1) & (((b >= 0x80) & (b <= 0x82)) | (b == 0x9E) | (b == 0x9F))
    han = ((a >= 0xE3) & (a <= 0xE9)) | ((a == 0xEF) & (b >= 0xA4) & (b <= 0xAB)) | ((a == 0xF0) & (b >= 0xA0) & (b <= 0xB3))
    return at[thai | myanmar | han]


def _split(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, from, to) of the parts of the spans: each unspaced character is one, and what stands between them."""
    at = _unspaced(data)
    whole = np.arange(len(lo))
    if not len(at):
        return whole, lo, hi
    lead = np.flatnonzero(_LEAD[data])
    behind = np.append(lead, len(data))[np.searchsorted(lead, at, side="right")]
    cuts = np.unique(np.concatenate([at, behind]))
    own = np.searchsorted(lo, cuts, side="right") - 1
    inside = (own >= 0) & (cuts > lo[own]) & (cuts < hi[own])
    cuts, own = cuts[inside], own[inside]
    word = np.concatenate([whole, own])
    start = np.concatenate([lo, cuts])
    order = np.argsort(start, kind="stable")
    word, start = word[order], start[order]
    last = np.append(word[1:] != word[:-1], True)
    return word, start, np.where(last, hi[word], np.append(start[1:], 0))


class Templates:
    """Tokens of consecutive texts: ``key`` (literal hash or type), ``value`` (literal hash), ``kind``;
    ``first[i]:first[i + 1]`` are those of text ``i``."""

    def __init__(self, w: Words):
        data = w.data
        core = np.flatnonzero(_CORE[data])
        a, z = np.searchsorted(core, w.start), np.searchsorted(core, w.end)
        some = z > a
        start, end = w.start[some], w.end[some]
        text = np.repeat(np.arange(len(w)), w.counts)[some]
        word, lo, hi = _split(data, core[a[some]], core[z[some] - 1] + 1)
        start, end, text = start[word], end[word], text[word]
        self.value = hash_spans(_LOWER[data], lo, hi)
        self.first = np.searchsorted(text, np.arange(len(w) + 1))
        n = len(lo)
        self.kind = np.zeros(n, dtype=np.int8)
        self.opens, self.ends = np.ones(n, dtype=bool), np.ones(n, dtype=bool)  # first and last tokens of lines
        if n:
            numeric = np.concatenate([[0], np.cumsum(_NUMERIC[data])])
            digit = _DIGIT[data[lo]]
            number = digit & (numeric[hi] - numeric[lo] == hi - lo)
            self.kind[digit] = QTY
            self.kind[number] = NUM
            behind = np.concatenate([[False], number[:-1] & (text[1:] == text[:-1])])
            self.kind[behind & _member(self.value, _UNIT_HASHES) & ~digit] = UNIT
            feeds = np.concatenate([[0], np.cumsum(data == 0x0A)])
            fresh = np.ones(n, dtype=bool)
            newline = (text[1:] != text[:-1]) | (feeds[start[1:]] != feeds[end[:-1]])
            self.opens[1:], self.ends[:-1] = newline, newline
            fresh[1:] = newline | _STOP[data[end[:-1] - 1]]
            ahead = np.minimum(lo + 1, len(data) - 1)
            b0, b1 = data[lo], data[ahead]
            two = np.minimum(lo + 2, len(data) - 1)
            ascii_name = (b0 >= 65) & (b0 <= 90) & (hi - lo > 1) & _SMALL[b1]
            latin_name = (b0 == 0xC3) & (b1 >= 0x80) & (b1 <= 0x9E) & (hi - lo > 2) & _SMALL[data[two]]
            title = ascii_name | latin_name
            self.kind[title & ~fresh] = NAME
            own = self.value ^ mix(text.astype(np.uint64))
            self.kind[np.flatnonzero(title & fresh)[np.isin(own[title & fresh], own[title & ~fresh])]] = NAME
        self.key = np.where(self.kind > 0, _TYPE[self.kind], self.value)
        self._placed: dict[tuple[int, int], np.ndarray] = {}

    def placed(self, width: int, literals: int) -> np.ndarray:
        """Hash of the template window that starts at each token, 0 for those with too few literals; with
        ``literals`` 0 of the verbatim window. Windows may run on into the next text."""
        if (width, literals) not in self._placed:
            h = windows(self.key if literals else self.value, width)
            if literals and len(h):
                solid = np.concatenate([[0], np.cumsum(self.kind == 0)])
                h = np.where(solid[width:] - solid[:-width] >= literals, h, np.uint64(0))
            self._placed[width, literals] = h
        return self._placed[width, literals]

    def windows(self, width: int, literals: int) -> tuple[np.ndarray, np.ndarray]:
        """(first token, hash) of the windows with enough literals, in order."""
        n = np.diff(self.first)
        at = ranges(self.first[:-1], np.maximum(n - width + 1, 0))
        solid = np.concatenate([[0], np.cumsum(self.kind == 0)])
        at = at[solid[at + width] - solid[at] >= literals]
        return at, windows(self.key, width)[at] if len(at) else np.zeros(0, dtype=np.uint64)

    def verbatim(self, width: int, slots: bool) -> tuple[np.ndarray, np.ndarray]:
        """(first token, hash) of the windows with their values, of those with a slot only if ``slots`` (the hash of
        a window without one is that of its template)."""
        at = ranges(self.first[:-1], np.maximum(np.diff(self.first) - width + 1, 0))
        if slots:
            solid = np.concatenate([[0], np.cumsum(self.kind == 0)])
            at = at[solid[at + width] - solid[at] < width]
        return at, windows(self.value, width)[at] if len(at) else np.zeros(0, dtype=np.uint64)

    def fingerprints(self, width: int, literals: int, short: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first token, hash, width) of both kinds of windows, and of verbatim ones of the widths ``short``."""
        parts = [(width, *self.windows(width, literals)), (width, *self.verbatim(width, literals <= width)), *[(k, *self.verbatim(k, False)) for k in short]]
        return np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts]), np.concatenate([np.full(len(p[1]), p[0]) for p in parts])


class _Items:
    """A block of benchmark items as sorted arrays, for look-up in tasks."""

    def __init__(self, ids: list, texts: list[str], width: int, literals: int):
        self.ids, self.width, self.literals = ids, width, literals
        short = set()
        hashes, item, at = [], [], []
        self.kind, self.value, self.size = [], [], []
        self.template, self.verbatim = [], []  # of each item the hashes of its windows, by place
        for i, j, w in batches(pa.array(texts, pa.string())):
            t = Templates(w)
            size = np.diff(t.first)
            few = sorted(set(size[(size > 0) & (size < width)].tolist()))
            start, h, wide = t.fingerprints(width, literals, few)
            own = np.searchsorted(t.first, start, side="right") - 1
            mine = wide == np.minimum(size[own], width)  # shorter windows only where they are the whole item
            start, h, own = start[mine], h[mine], own[mine]
            short.update(few)
            hashes.append(h)
            item.append(own + i)
            at.append(start - t.first[own])
            for k in range(j - i):
                self.kind.append(t.kind[t.first[k] : t.first[k + 1]])
                self.value.append(t.value[t.first[k] : t.first[k + 1]])
                size_k = int(t.first[k + 1] - t.first[k])
                wide = min(width, size_k)
                own = slice(t.first[k], t.first[k] + size_k - wide + 1) if wide else slice(0, 0)
                self.size.append(size_k)
                self.template.append(t.placed(width, literals)[own] if wide == width else np.zeros(min(wide, 1), dtype=np.uint64))
                self.verbatim.append(t.placed(wide, 0)[own] if wide else np.zeros(0, dtype=np.uint64))
        self.short = sorted(short)
        h = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
        order = np.argsort(h, kind="stable")
        self.hash = h[order]
        self.item = np.concatenate(item)[order] if item else np.zeros(0, dtype=np.int64)
        self.at = np.concatenate(at)[order] if at else np.zeros(0, dtype=np.int64)
        bits = np.zeros(_BITS, dtype=bool)
        bits[(self.hash % np.uint64(_BITS)).astype(np.int64)] = True
        self.bits = np.packbits(bits)

    @staticmethod
    def _alignments(shifts: np.ndarray, seen: np.ndarray, size: int) -> np.ndarray:
        """Of the alignments with equal tokens of the text one each; those that leave the text stay."""
        inside = (shifts >= 0) & (shifts + size <= len(seen))
        if inside.sum() < 2:
            return shifts
        _, one = np.unique(windows(seen, size)[shifts[inside]], return_index=True)
        return np.concatenate([shifts[~inside], shifts[inside][one]])

    def matches(self, t: Templates, k: int, start: np.ndarray, hashes: np.ndarray, cover: float, least: int, run: int) -> list[tuple]:
        """(item id, coverage, verbatim) of the items that contaminate text ``k``; ``start`` and ``hashes`` are
        those of its windows that some item has."""
        base, tokens = t.first[k], t.first[k + 1] - t.first[k]
        own = slice(base, base + tokens)
        role = t.kind[own].astype(np.uint64) + np.uint64(8) * t.opens[own] + np.uint64(16) * t.ends[own]
        seen = mix(t.value[own] ^ mix(role + np.uint64(1)))
        here = start - base
        each = np.unique(hashes)
        if len(each) < len(hashes):
            # places whose surroundings are equal as far as any item reaches lie in equal alignments: one is enough
            lo, hi = np.searchsorted(self.hash, each, side="left"), np.searchsorted(self.hash, each, side="right")
            reach = max(self.size[i] for i in np.unique(self.item[ranges(lo, hi - lo)]))
            edge = np.full(reach, np.uint64(0))
            around = windows(np.concatenate([edge, seen, ~edge]), 2 * reach)[here]
            order = np.lexsort((here, hashes, around))
            new = np.append(True, (np.diff(around[order]) != 0) | (np.diff(hashes[order]) != 0))
            here, hashes = here[order[new]], hashes[order[new]]
        lo, hi = np.searchsorted(self.hash, hashes, side="left"), np.searchsorted(self.hash, hashes, side="right")
        there = ranges(lo, hi - lo)
        item, at, shift = self.item[there], self.at[there], np.repeat(here, hi - lo) - self.at[there]
        order = np.lexsort((shift, item))
        item, at, shift = item[order], at[order], shift[order]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(item)) + 1, [len(item)]])
        found = []
        for p, q in zip(cuts[:-1], cuts[1:]):
            i = item[p]
            size = self.size[i]
            wide = min(self.width, size)
            # an item with too few windows in this text can't be covered, nor have a run in it
            if len(np.unique(at[p:q])) < min(min(cover * size, least) / wide, max(run - wide + 1, 1)):
                continue
            hit, same, long = np.zeros(size, dtype=bool), True, False
            for s in self._alignments(np.unique(shift[p:q]), seen, size):
                if size == 1 and not (t.opens[base + s] and t.ends[base + s]):
                    continue  # an item of one token has to be a whole line
                a, z = max(0, -s), min(size, tokens - s) - wide + 1
                there_t, there_v = t.placed(self.width, self.literals), t.placed(wide, 0)
                agree = self.verbatim[i][a:z] == there_v[base + s + a : base + s + z]
                if wide == self.width:
                    own_t = self.template[i][a:z]
                    agree |= (own_t != 0) & (own_t == there_t[base + s + a : base + s + z])
                first = np.flatnonzero(agree) + a
                own = _spans(first, wide, size)
                slots = np.flatnonzero(own & (self.kind[i] > 0))
                x, y, kind = self.value[i][slots], t.value[base + slots + s], self.kind[i][slots]
                if (x != y).any():
                    split = _split_values(x, y, kind)
                    if (split & (kind == NAME)).any():
                        own[:] = False
                    else:
                        split |= _split_values(y, x, kind)
                        wrong = np.zeros(size + 1, dtype=np.int64)
                        wrong[slots[split] + 1] = 1
                        wrong = np.cumsum(wrong)
                        own = _spans(first[wrong[first + wide] == wrong[first]], wide, size)
                        same = False
                hit |= own
                a, z = max(0, -s), min(size, tokens - s)
                equal = np.zeros(size + 1, dtype=np.int64)
                equal[a + 1 : z + 1] = self.value[i][a:z] == t.value[base + s + a : base + s + z]
                equal = np.cumsum(equal)
                runs = np.flatnonzero(equal[run:] - equal[:-run] == run)
                if len(runs):
                    long = True
                    hit |= _spans(runs, run, size)
            n = int(hit.sum())
            if long or n >= max(cover * size, min(least, size)):
                found.append((self.ids[i], n / size, same))
        return found


def _spans(first: np.ndarray, width: int, size: int) -> np.ndarray:
    """Which of ``size`` tokens lie in the windows that start at ``first``."""
    out = np.zeros(size, dtype=bool)
    out[(first[:, None] + np.arange(width)).ravel()] = True
    return out


def _split_values(x: np.ndarray, y: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Which slots hold a value of ``x`` that stands, with the same type, for several of ``y``."""
    pairs = np.unique(np.stack([x, kind.astype(np.uint64), y], axis=1), axis=0)
    own, n = np.unique(pairs[:, :2], axis=0, return_counts=True)
    several = own[n > 1]
    return ((x[:, None] == several[:, 0]) & (kind[:, None] == several[:, 1])).any(axis=1)


def find(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, literals: int = LITERALS, cover: float = COVER, least: int = LEAST, run: int = RUN) -> DataFrame:
    """(doc_id, item_id, coverage, verbatim) of every contaminated pair, a row each."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, coverage double, verbatim boolean"
    listed = items.select(F.col(f"`{item_col}`").cast("long").alias("item_id"), F.col(f"`{item_text_col}`").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    chars = listed.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // BLOCK_CHARS))
    texts = with_text(docs, id_col, text_col)
    result = None
    for b in range(blocks):
        rows = listed.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()  # about BLOCK_CHARS characters
        block = spark.sparkContext.broadcast(_Items([r[0] for r in rows], [r[1] for r in rows], width, literals))

        def scan(batch_iter, block=block):
            known = block.value
            bits = np.unpackbits(known.bits).astype(bool)
            for batch in batch_iter:
                ids = batch.column("doc_id").to_pylist()
                out: list[tuple] = []
                for i, _, w in batches(batch.column("text")):
                    t = Templates(w)
                    start, h, _ = t.fingerprints(known.width, known.literals, known.short)
                    maybe = bits[(h % np.uint64(_BITS)).astype(np.int64)]
                    start, h = start[maybe], h[maybe]
                    hit = _member(h, known.hash)
                    start, h = start[hit], h[hit]
                    order = np.argsort(start, kind="stable")
                    start, h = start[order], h[order]
                    own = np.searchsorted(t.first, start, side="right") - 1
                    edge = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1, [len(own)]]) if len(own) else [0]
                    for p, q in zip(edge[:-1], edge[1:]):
                        out += [(ids[i + own[p]], *m) for m in known.matches(t, own[p], start[p:q], h[p:q], cover, least, run)]
                if out:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64(), pa.bool_()))], names=["doc_id", "item_id", "coverage", "verbatim"])

        part = texts.mapInArrow(scan, schema)
        part = materialize(part, "leaks") if blocks > 1 else part
        result = part if result is None else result.unionByName(part)
    return result.distinct()


def report(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """doc_id, contaminated, item_ids (sorted), coverage (the largest), verbatim (all slots equal in some
    match) of every row of ``docs``."""
    found = find(docs, items, id_col, **options).groupBy(F.col("doc_id").alias("leaked")).agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("coverage").alias("coverage"), F.max("verbatim").alias("verbatim"))
    found = materialize(found, "leaks-by-document")
    every = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"))
    joined = every.join(found, F.col("doc_id").eqNullSafe(F.col("leaked")) & F.col("coverage").isNotNull(), "left")
    return joined.select("doc_id", F.col("coverage").isNotNull().alias("contaminated"), F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.coalesce("verbatim", F.lit(False)).alias("verbatim"))


def remove(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the contaminated documents, all columns kept."""
    leaked = free_name(docs, "__leaked")
    found = materialize(find(docs, items, id_col, **options).select(F.col("doc_id").alias(leaked)).distinct(), "leaked")
    return docs.join(found, docs[id_col].cast("long").eqNullSafe(F.col(leaked)), "left_anti")
