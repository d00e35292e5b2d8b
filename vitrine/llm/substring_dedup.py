"""Substring dedup: remove words of long passages that an earlier document has, found by recompression.

A window is ``WIDTH`` consecutive words of one document. A word goes when a window that covers it has a
word sequence that also starts in a document with a smaller id; windows are judged on the input.

1. Every text is recompressed (``recompression``): rounds name runs and pairs by content, so equal
   substrings carry equal symbols except near their ends. After ``ROUNDS`` rounds a window's anchor is
   the first symbol that its own words decide, at the highest level that has one (words themselves at
   least, so each window has an anchor). Equal windows have equal anchors.
2. Packed postings of the anchors tell each document which of its anchors another document has. Windows
   with other anchors are unique and leave.
3. The remaining windows are verified over the whole sequence of words (64-bit hash of 50 word hashes);
   packed postings of those tell a document which of its windows a smaller id has.

Defined cases: null, empty and white-space-only texts have no words and stay empty; a text of fewer than
``WIDTH`` words loses nothing; rows that repeat an id are one document each but not earlier than each
other; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.postings import SCHEMA, Packer, shared_by_owner, short
from vitrine.llm.recompression import levels
from vitrine.llm.runtime import bucket_count, with_text
from vitrine.llm.textarrays import Words, batches, joined, mix, windows

WIDTH = 50
ROUNDS = 5


def anchors(w: Words, width: int = WIDTH, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(first word, anchor) of every window, in order."""
    doc = np.repeat(np.arange(len(w)), w.counts)
    at = np.arange(len(doc))
    start = at[at + width <= w.first[1:][doc]]
    key = np.zeros(len(start), dtype=np.uint64)
    todo = np.arange(len(start))
    all_levels = levels(w.hashes(), doc, rounds)
    for r in range(rounds, -1, -1):
        if not len(todo):
            break
        s, p = all_levels[r], start[todo]
        i = np.searchsorted(s.low, p)
        inside = i < len(s)
        i = np.minimum(i, len(s) - 1)
        inside &= s.high[i] <= p + width
        key[todo[inside]] = mix(s.name[i[inside]] + np.uint64(r + 1))
        todo = todo[~inside]
    return start, key


def _per_text(w: Words, start: np.ndarray) -> np.ndarray:
    """Bounds of each text's windows in ``start``."""
    return np.searchsorted(start, w.first)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_words, n_removed, text (the kept words joined by one space) of every document."""
    texts = with_text(docs, id_col, text_col)
    buckets = bucket_count(docs)

    def post_anchors(batch_iter):
        packer = Packer(buckets)
        for b in batch_iter:
            ids = b.column("doc_id").to_pylist()
            for i, _, w in batches(b.column("text")):
                start, key = anchors(w, width, rounds)
                cut = _per_text(w, start)
                for k in range(len(w)):
                    if cut[k + 1] > cut[k] and ids[i + k] is not None:
                        yield from packer.add(ids[i + k], 0, np.unique(key[cut[k] : cut[k + 1]]))
        yield from packer.flush()

    def post_windows(batch_iter):
        packer = Packer(buckets, wide=True)
        for b in batch_iter:
            ids, known = b.column("doc_id").to_pylist(), b.column("tokens")
            for i, _, w in batches(b.column("text")):
                start, key = anchors(w, width, rounds)
                cut, key, whole = _per_text(w, start), short(key, buckets), windows(w.hashes(), width)
                for k in range(len(w)):
                    a, z = cut[k], cut[k + 1]
                    if z > a:
                        hit = np.isin(key[a:z], np.frombuffer(known[i + k].as_buffer(), dtype=np.uint64))
                        yield from packer.add(ids[i + k], 0, np.unique(whole[start[a:z][hit]]))
        yield from packer.flush()

    def remove(batch_iter):
        for b in batch_iter:
            repeated = b.column("tokens")
            parts, n_words, n_removed = [], [], []
            for i, _, w in batches(b.column("text")):
                keep = np.ones(len(w.start), dtype=bool)
                if repeated.null_count < len(repeated):
                    whole = windows(w.hashes(), width)
                    for k in range(len(w)):
                        t, a, n = repeated[i + k], w.first[k], w.counts[k]
                        if t.is_valid and n >= width:
                            hit = np.isin(whole[a : a + n - width + 1], np.frombuffer(t.as_buffer(), dtype=np.uint64))
                            cover = np.zeros(n + 1, dtype=np.int64)
                            cover[: n - width + 1] += hit
                            cover[width:] -= hit
                            keep[a : a + n] = np.cumsum(cover)[:n] == 0
                kept = np.diff(np.concatenate([[0], np.cumsum(keep)])[w.first])
                parts.append(joined(w, keep))
                n_words.append(w.counts)
                n_removed.append(w.counts - kept)
            if parts:
                yield pa.record_batch([b.column("doc_id"), pa.array(np.concatenate(n_words), pa.int64()), pa.array(np.concatenate(n_removed), pa.int64()), pa.concat_arrays(parts)], names=["doc_id", "n_words", "n_removed", "text"])

    shared = shared_by_owner(texts.mapInArrow(post_anchors, SCHEMA), buckets, "shared-anchors")
    candidates = texts.join(shared.select(F.col("owner").alias("doc_id"), "tokens"), "doc_id")
    repeated = shared_by_owner(candidates.mapInArrow(post_windows, SCHEMA), buckets, "repeated-windows", wide=True, later=True)
    marked = texts.join(repeated.select(F.col("owner").alias("doc_id"), "tokens"), "doc_id", "left")
    return marked.mapInArrow(remove, "doc_id long, n_words long, n_removed long, text string")
