"""N-gram Jaccard join: near-duplicate texts by token-combination prefixes, exact at the threshold.

A text's set is its distinct ``SHINGLE``-word shingles (64-bit hashes) after lower-casing A-Z; a text with fewer
words is one shingle. Two texts link when 100 * |x & y| >= 75 * |x | y|; links are closed to components.

1. Texts with equal sets fold into one class (a 64-bit signature of the whole set).
2. Packed postings tell each class which of its tokens another class has. A class with less than 75 %
   such tokens has no partner and leaves.
3. The remaining classes' postings meet again, and with each token that two of them share comes how many have it
   (a byte: exact while rare, in steps beyond it, the same for all classes; it orders tokens and splits them in rare
   and frequent ones).
   Tokens are ordered unshared first, then by frequency: linked sets that need ``o`` common
   tokens share at least ``m`` of them within their first ``|x| - o + m``. The prefix is extended to
   ``m = g + 1``: either one of the common tokens there is rare, and rare tokens are indexed singly, or
   ``g + 1`` frequent ones fall in ``g`` hash groups, so two share a group, and 2-token combinations
   within a group are indexed. ``g`` grows with the set's size, so the index stays linear.
4. Candidates are verified on whole sets. Members of an index key are compared with the key's least
   edited class first; links found so fold most of a family. What is left in a key over different
   components is compared pair by pair, each pair verified once, except pairs that can't reach the
   threshold: by their sizes, and by how many shared tokens (for a combination: frequent ones, as a pair
   with a rare token in common meets there too) either has at all. No pair inside a component needs a test.

Defined cases: null, empty and white-space-only texts have size 0 and are their own component; equal
rows (same id) come out once; an empty table gives an empty result; extra columns are ignored by
``near_duplicates`` and kept by ``keep_one``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.postings import SCHEMA, Packer, groups, shared_by_owner, unpack_parts
from vitrine.llm.runtime import bucket_count, free_name, input_bytes, materialize, with_text
from vitrine.llm.textarrays import batches, mix, windows
from vitrine.operators.components import components

SHINGLE = 5
#: Similarity in percent.
PERCENT = 75
#: A token in at most this many classes is rare.
RARE = 32
#: Bytes of text hashed at a time: its hashes and powers take some fifty times as much.
CHUNK = 1 << 18
#: Bytes of joinable sets for each bucket of the index.
INDEX_BUCKET = 16 << 20
#: A bucket's keys are gone through in so many parts.
_PARTS = 8


def shingle_sets(texts: pa.Array, width: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    for _, _, w in batches(texts, lower=True, chunk=CHUNK):
        h = w.hashes()
        g = windows(h, width)
        for a, n in zip(w.first[:-1], w.counts):
            if n >= width:
                yield np.unique(g[a : a + n - width + 1])
            elif n:
                acc = np.uint64(n)
                for x in h[a : a + n]:
                    acc = mix(np.array([acc ^ x]))[0]
                yield np.array([acc], dtype=np.uint64)
            else:
                yield np.zeros(0, dtype=np.uint64)


def signature(s: np.ndarray) -> int:
    """64 bits of the whole set; 0 for the empty one."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) if len(s) else 0


def _needed(size: int, percent: int) -> int:
    """Least number of common tokens of a set of ``size`` with any partner."""
    return -(-size * percent // 100)


def _classes(size: int, percent: int) -> list[int]:
    """Size classes in which a set meets its partners: that of each possible larger size."""
    return sorted({int(size).bit_length(), int(size * 100 // percent).bit_length()})


def index_keys(tokens: np.ndarray, size: int, frequency: np.ndarray, percent: int = PERCENT, rare: int = RARE) -> tuple[np.ndarray, np.ndarray]:
    """(single keys, combination keys) of one set: ``tokens`` are its shared ones, ``frequency`` how many
    classes have each. A linked pair that shares no single key has frequent tokens only in common."""
    order = np.lexsort((tokens, frequency))
    tokens, often = tokens[order], frequency[order] > rare
    ahead = size - len(tokens)
    single, combined = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.uint64)]
    for c in _classes(size, percent):
        g = max(1, (1 << c) // 32)
        m = max(0, min(len(tokens), size - _needed(size, percent) + g + 1 - ahead))
        single.append(mix(tokens[:m][~often[:m]]))
        t = tokens[:m][often[:m]]
        if _needed(size, percent) < g + 1:
            combined.append(mix(t))
            continue
        if len(t) < 2:
            continue
        cell = mix(t ^ np.uint64(c)) % np.uint64(g)
        by, start, n = groups(cell)
        t = t[by]
        # all pairs (i < j) within each group
        later = np.concatenate([np.arange(k - 1, -1, -1) for k in n])
        first = np.repeat(np.arange(len(t)), later)
        second = first + 1 + np.arange(len(first)) - np.repeat(np.concatenate([[0], np.cumsum(later)[:-1]]), later)
        x, y = np.minimum(t[first], t[second]), np.maximum(t[first], t[second])
        combined.append(mix(mix(x) + y * np.uint64(0x9E3779B97F4A7C15) + np.uint64(c)))
    return np.unique(np.concatenate(single)), np.unique(np.concatenate(combined))


def _index(shared: DataFrame, buckets: int, percent: int) -> DataFrame:
    """Packed (key, class) postings of the classes in ``shared``."""

    def emit(batch_iter):
        packer = Packer(buckets, salt_hot=False, copies=False)
        for b in batch_iter:
            for own, size, comp, t, f in zip(*(b.column(c).to_pylist() for c in ("owner", "size", "component")), b.column("tokens"), b.column("often")):
                tokens, often = np.frombuffer(t.as_buffer(), dtype=np.uint64), np.frombuffer(f.as_buffer(), dtype=np.uint8)
                single, combined = index_keys(tokens, size, often, percent)
                # with each key: how many tokens a pair that only meets there can have in common
                frequent = int((often > RARE).sum())
                yield from packer.add(own, _pack(size, frequent, len(tokens) - frequent), single, comp)
                yield from packer.add(own, _pack(size, frequent, 0), combined, comp)
        yield from packer.flush()

    return shared.select("owner", "size", "component", "tokens", "often").mapInArrow(emit, SCHEMA)


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar enough."""

    def test(batch_iter):
        for b in batch_iter:
            ok = []
            for x, y, m, n in zip(b.column("x"), b.column("y"), b.column("m").to_pylist(), b.column("n").to_pylist()):
                both = len(np.intersect1d(np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64), assume_unique=True))
                ok.append(100 * both >= percent * (m + n - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.record_batch([b.column("a").filter(keep), b.column("b").filter(keep)], names=["a", "b"])

    left = sets.select(F.col("owner").alias("a"), F.col("tokens").alias("x"), F.col("size").alias("m"))
    right = sets.select(F.col("owner").alias("b"), F.col("tokens").alias("y"), F.col("size").alias("n"))
    joined = pairs.join(right, "b").join(left, "a")
    return joined.select("a", "b", "x", "y", "m", "n").mapInArrow(test, "a long, b long")


_SHARE = (1 << 15) - 1


def _pack(size: int, frequent: int, rare: int) -> int:
    """A set's size, and how many frequent and rare shared tokens it has, as shares rounded up."""
    return size | -(-frequent * _SHARE // size) << 32 | -(-rare * _SHARE // size) << 47


def _unpacked(table: pa.Table):
    """(class, size, frequent tokens, rare tokens, component, key) of a bucket's postings, a part of its keys at a
    time; the two counts are upper bounds of what a pair that meets at the key can have in common of either sort."""
    for own, told, comp, key in unpack_parts(table, _PARTS):
        size = told & 0xFFFFFFFF
        yield own, size, (told >> 32 & _SHARE) * size / _SHARE, (told >> 47 & _SHARE) * size / _SHARE, comp, key


def _distinct(pairs: list[np.ndarray], votes: list[np.ndarray] | None = None):
    """The distinct rows of (a, b) tables, with the sum of their votes if these are given."""
    both = np.concatenate([np.zeros((0, 2), dtype=np.int64), *pairs])
    order = np.lexsort((both[:, 1], both[:, 0]))
    both = both[order]
    start = np.flatnonzero(np.concatenate([[True], (both[1:] != both[:-1]).any(axis=1)])) if len(both) else np.zeros(0, dtype=np.int64)
    if votes is None:
        return both[start]
    return both[start], np.add.reduceat(np.concatenate(votes)[order], start) if len(both) else np.zeros(0, dtype=np.int64)


def _possible(percent: int, size_x, size_y, frequent_x, frequent_y, rare_x, rare_y):
    """Whether two sets could reach the threshold: |x & y| >= percent / (100 + percent) * (|x| + |y|)."""
    return (100 + percent) * (np.minimum(frequent_x, frequent_y) + np.minimum(rare_x, rare_y) + 1e-6) >= percent * (size_x + size_y)


def _star(postings: DataFrame, percent: int) -> DataFrame:
    """One pair for each class that shares a key with another component: with the head of a key (the class
    whose tokens are shared most, so the least edited one of a family) that comes up in most of its keys."""

    def find(table: pa.Table) -> pa.Table:
        pairs, votes = [], []
        for own, size, often, rare, comp, key in _unpacked(table):
            order = np.lexsort((own, -(often + rare) / size, key))
            o, c, k, s, f, r = own[order], comp[order], key[order], size[order], often[order], rare[order]
            start = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1])
            n = np.diff(np.concatenate([start, [len(k)]]))
            head, at = np.repeat(o[start], n), np.repeat(start, n)
            other = (c != c[at]) & _possible(percent, s, s[at], f, f[at], r, r[at])
            # (head, member), as heads are what a member has to choose from
            found = _distinct([np.stack([head[other], o[other]], axis=1)], [np.ones(int(other.sum()), dtype=np.int64)])
            pairs.append(found[0])
            votes.append(found[1])
        both, told = _distinct(pairs, votes)
        return pa.table({"a": pa.array(both[:, 0], pa.int64()), "b": pa.array(both[:, 1], pa.int64()), "votes": pa.array(told, pa.int64())})

    seen = postings.groupBy("bucket").applyInArrow(find, "a long, b long, votes long").groupBy("a", "b").agg(F.sum("votes").alias("votes"))
    return seen.groupBy("b").agg(F.max(F.struct("votes", "a")).alias("best")).select(F.col("best.a").alias("a"), "b")


def _rest(postings: DataFrame, percent: int) -> DataFrame:
    """All pairs (a < b) of classes of different components that share a key and could be similar enough
    by their sizes and by how many of their tokens are shared with anyone."""

    def find(table: pa.Table) -> pa.Table:
        out, held, most = [], 0, 2_000_000
        for own, size, often, rare, comp, key in _unpacked(table):
            order, start, n = groups(key)
            o, c, s, f, r = own[order], comp[order], size[order], often[order], rare[order]
            mixed = np.minimum.reduceat(c, start) != np.maximum.reduceat(c, start)
            for a, k in zip(start[mixed], n[mixed]):
                by = a + np.argsort(s[a : a + k], kind="stable")
                po, pc, ps, pf, pr = o[by], c[by], s[by], f[by], r[by]
                end = np.searchsorted(ps, ps * 100 // percent, side="right")
                for i in range(k - 1):
                    j = slice(i + 1, end[i])
                    j = i + 1 + np.flatnonzero((pc[j] != pc[i]) & _possible(percent, ps[j], ps[i], pf[j], pf[i], pr[j], pr[i]))
                    if len(j):
                        out.append(np.stack([np.minimum(po[i], po[j]), np.maximum(po[i], po[j])], axis=1))
                        held += len(j)
                    if held > most:
                        out = [_distinct(out)]
                        held, most = len(out[0]), max(most, 2 * len(out[0]))
        both = _distinct(out)
        return pa.table({"a": pa.array(both[:, 0], pa.int64()), "b": pa.array(both[:, 1], pa.int64())})

    return postings.groupBy("bucket").applyInArrow(find, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    texts = with_text(docs, id_col, text_col)
    buckets = bucket_count(docs)

    def describe(batch_iter):
        for b in batch_iter:
            sizes, marks = [], []
            for s in shingle_sets(b.column("text"), width):
                sizes.append(len(s))
                marks.append(signature(s))
            yield pa.record_batch([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(marks, pa.int64())], names=["doc_id", "size", "owner"])

    def post(batch_iter):
        packer = Packer(buckets)
        for b in batch_iter:
            for s in shingle_sets(b.column("text"), width):
                yield from packer.add(signature(s), len(s), s)
        yield from packer.flush()

    def post_again(batch_iter):
        # tokens are in their short form, whose upper bits don't spread
        packer = Packer(buckets, mark=1)
        for b in batch_iter:
            for own, size, t in zip(b.column("owner").to_pylist(), b.column("size").to_pylist(), b.column("tokens")):
                yield from packer.add(own, size, mix(np.frombuffer(t.as_buffer(), dtype=np.uint64)))
        yield from packer.flush()

    members = materialize(texts.mapInArrow(describe, "doc_id long, size long, owner long").distinct(), "shingle-classes")
    shared = shared_by_owner(texts.mapInArrow(post, SCHEMA), buckets, "shared-shingles")
    shared = shared.where((F.length("tokens") / 8 * 100 >= F.col("size") * percent) & (F.col("size") > 2))
    # of the remaining classes only: what they share, and with how many of them
    shared = shared_by_owner(shared.select("owner", "size", "tokens").mapInArrow(post_again, SCHEMA), buckets, "joinable", frequencies=True)

    # as few buckets as their bounded size allows: a pair that shares keys in many comes up in each
    index_buckets = max(8, -(-input_bytes(shared) // INDEX_BUCKET))
    # every class is its own component at first; stars fold most groups, then the rest is tested pair by pair
    links = shared.select(F.col("owner").alias("a"), F.col("owner").alias("b")).limit(0)
    for step in ("star", "rest"):
        labelled = _labelled(shared, links)
        index = _index(labelled, index_buckets, percent)
        tested = materialize(_star(index, percent) if step == "star" else _rest(index, percent), f"pairs-{step}")
        links = materialize(links.union(_verify(tested, shared, percent)), f"links-{step}")
    return _answer(members, links)


def _labelled(shared: DataFrame, links: DataFrame) -> DataFrame:
    """``shared`` with the component of each class by the links so far (its own id without any)."""
    if links.isEmpty():
        return shared.withColumn("component", F.col("owner"))
    found = components(links, store=materialize).select(F.col("node").alias("owner"), "component")
    return shared.join(found, "owner", "left").withColumn("component", F.coalesce("component", "owner"))


def _answer(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members of linked classes get the smallest document of their classes' component."""
    found = components(links, store=materialize).select(F.col("node").alias("owner"), "component")
    # a class's smallest document first, so that no member list is ever held together
    least = members.where("size > 0").groupBy("owner").agg(F.min("doc_id").alias("first"))
    group = least.join(found, "owner", "left").withColumn("component", F.coalesce("component", "owner"))
    heads = group.groupBy("component").agg(F.min("first").alias("component_id"))
    of_class = group.join(heads, "component").select("owner", "component_id")
    return members.join(of_class, "owner", "left").select("doc_id", F.col("size").alias("n_shingles"), F.coalesce(F.when(F.col("size") > 0, F.col("component_id")), F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id."""
    found = near_duplicates(docs, id_col, text_col, **options)
    name = free_name(docs, "__dropped")
    dropped = materialize(found.where("component_id <> doc_id").select(F.col("doc_id").alias(name)), "near-duplicates")
    return docs.join(dropped, docs[id_col] == F.col(name), "left_anti")
