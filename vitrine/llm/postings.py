"""Packed postings: (token, owner) pairs in hash buckets, a row per bucket and flush instead of per pair.

A map side packs the distinct (owner, token) pairs of many owners by bucket; a reduce side sees all
pairs of a bucket as numpy arrays. The number of buckets follows the input, so a bucket has a bounded
size. A token that is hot within one flush already has two owners there: only two of its pairs go to
its own bucket (so that owners elsewhere learn that it is shared), all others travel in buckets that
are salted by owner and need no look-up. No pair is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vitrine.llm.runtime import materialize
from vitrine.llm.textarrays import mix

#: Pairs that a map task holds before it writes a row per bucket.
FLUSH = 1_000_000
#: A token with more pairs than this in one flush is hot.
HOT = 4096
#: Code of a token that was hot in some flush.
_HOT_CODE = 255
#: A bucket's tokens are gone through in so many parts.
_PARTS = 8

SCHEMA = "bucket long, owners binary, sizes binary, extras binary, counts binary, lo binary, hi binary"
_ARROW = pa.schema([("bucket", pa.int64()), *[(c, pa.binary()) for c in ("owners", "sizes", "extras", "counts", "lo", "hi")]])
_LOW32, _LOW48 = np.uint64(0xFFFFFFFF), np.uint64((1 << 48) - 1)


def bucket_of(tokens: np.ndarray, n: int) -> np.ndarray:
    return ((tokens >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def short(tokens: np.ndarray, n: int) -> np.ndarray:
    """The 64-bit form in which a token comes back: its low 48 bits and the low 16 of its bucket."""
    return (tokens & _LOW48) | (bucket_of(tokens, n) << np.uint64(48))


def frequency_code(n: np.ndarray) -> np.ndarray:
    """Numbers of owners as bytes that keep their order: exact up to 128, eighths of a power of two beyond it."""
    return np.where(n <= 128, n, np.minimum(128 + np.floor(8 * np.log2(np.maximum(n, 1) / 128.0)), _HOT_CODE - 1)).astype(np.uint8)


def _rows(bucket: np.ndarray, part: np.ndarray, parts: tuple[np.ndarray, np.ndarray, np.ndarray], marked: np.ndarray | None, mark: int, token: np.ndarray, wide: bool) -> Iterator[pa.RecordBatch]:
    """A row per bucket. Pairs of a part, which has one (owner, size, extra), are consecutive in the input and stay so."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cut = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
    for a, b in zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(bucket)]])):
        by = order[a:b]
        p, t = part[by], token[by]
        new = p[1:] != p[:-1]
        if marked is not None:
            m = marked[by]
            new |= m[1:] != m[:-1]
        new = np.concatenate([[0], np.flatnonzero(new) + 1])
        counts = np.diff(np.concatenate([new, [b - a]])).astype(np.uint32)
        o, s, e = (x[p[new]] for x in parts)
        if marked is not None:
            e = np.where(m[new], e | mark, e)
        columns = [o, s, e, counts, (t & _LOW32).astype(np.uint32), (t >> np.uint64(32)).astype(np.uint32) if wide else ((t >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.uint16)]
        yield pa.record_batch([pa.array([int(bucket[a])], pa.int64()), *[pa.array([c.tobytes()], pa.binary()) for c in columns]], schema=_ARROW)


class Packer:
    """Collects (owner, size, tokens) and writes rows of ``SCHEMA``. ``wide`` keeps all 64 bits of a token,
    else its bucket and low 48. ``mark`` goes into the extra number of a hot token's pairs that stay in its bucket."""

    def __init__(self, buckets: int, salt_hot: bool = True, wide: bool = False, copies: bool = True, mark: int = 0):
        self.buckets, self.salt_hot, self.wide, self.copies, self.mark, self.held, self.seen = buckets, salt_hot, wide, copies, mark, 0, set()
        self.parts: list[tuple[int, int, int, np.ndarray]] = []

    def add(self, owner: int, size: int, tokens: np.ndarray, extra: int = 0) -> Iterator[pa.RecordBatch]:
        """``tokens``: distinct; ``size`` and ``extra`` travel with the owner. With ``copies`` an owner seen
        before in this flush is an equal copy and skipped, else it brings further tokens."""
        if not len(tokens) or self.copies and owner in self.seen:
            return
        self.seen.add(owner)
        self.parts.append((owner, size, extra, tokens))
        self.held += len(tokens)
        if self.held >= FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        part = np.repeat(np.arange(len(self.parts), dtype=np.int32), [len(p[3]) for p in self.parts])
        parts = tuple(np.array([p[i] for p in self.parts], dtype=np.int64) for i in range(3))
        token = np.concatenate([p[3] for p in self.parts])
        self.parts, self.held, self.seen = [], 0, set()
        bucket = bucket_of(token, self.buckets).astype(np.int64)
        marked = None
        if self.salt_hot:
            cell = (token >> np.uint64(20)).astype(np.uint32) & np.uint32(0xFFFF)
            heavy = np.bincount(cell, minlength=1 << 16) > HOT
            if heavy.any():
                at = np.flatnonzero(heavy[cell])
                owner = parts[0][part[at]]
                values, inverse, counts = np.unique(token[at], return_inverse=True, return_counts=True)
                rank = np.empty(len(at), dtype=np.int64)
                by = np.lexsort((owner, inverse))
                rank[by] = np.arange(len(at)) - np.repeat(np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
                hot = counts[inverse] > HOT
                leaves = hot & (rank >= 2)
                away = at[leaves]
                # the salted number still tells the token's own bucket, as its remainder
                salts = np.uint64(1 + self.buckets // 256)
                bucket[away] = self.buckets * (1 + (mix(owner[leaves].astype(np.uint64)) % salts).astype(np.int64)) + bucket[away]
                if self.mark:
                    marked = np.zeros(len(token), dtype=bool)
                    marked[at[hot & (rank < 2)]] = True
        yield from _rows(bucket, part, parts, marked, self.mark, token, self.wide)


def unpack(table: pa.Table, wide: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owner, size, extra, token) of every pair of a table; tokens are their low 48 bits, or whole."""
    def joined(name: str, kind) -> np.ndarray:
        return np.frombuffer(b"".join(table.column(name).to_pylist()), dtype=kind)

    token = joined("lo", np.uint32).astype(np.uint64) | (joined("hi", np.uint32 if wide else np.uint16).astype(np.uint64) << np.uint64(32))
    counts = joined("counts", np.uint32)
    return *(np.repeat(joined(c, k), counts) for c, k in (("owners", np.int64), ("sizes", np.int64), ("extras", np.int64))), token


def unpack_parts(table: pa.Table, parts: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """What ``unpack`` gives for narrow tokens, a part of the tokens at a time: only tokens and the places of their
    owners are held for all pairs."""
    def joined(name: str, kind) -> np.ndarray:
        return np.frombuffer(b"".join(table.column(name).to_pylist()), dtype=kind)

    token = joined("hi", np.uint16).astype(np.uint64)
    token <<= np.uint64(32)
    token |= joined("lo", np.uint32)
    owners, sizes, extras = (joined(c, np.int64) for c in ("owners", "sizes", "extras"))
    place = np.repeat(np.arange(len(owners), dtype=np.int32), joined("counts", np.uint32))
    part = (mix(token) % np.uint64(parts)).astype(np.uint8)
    for i in range(parts):
        at = np.flatnonzero(part == i)
        if len(at):
            own = place[at]
            yield owners[own], sizes[own], extras[own], token[at]


def groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, start, count) of the runs of equal keys after sorting."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    start = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1]) if len(k) else np.zeros(0, dtype=np.int64)
    return order, start, np.diff(np.concatenate([start, [len(k)]]))


def shared_by_owner(postings: DataFrame, buckets: int, name: str, wide: bool = False, later: bool = False, frequencies: bool = False) -> DataFrame:
    """(owner, size, tokens): for each owner with any, its tokens that two or more owners have, or with
    ``later`` those that a smaller owner has. Tokens come sorted and distinct: whole when ``wide``, else in
    their ``short`` form. With ``frequencies`` a byte a token (``often``) goes with them, the ``frequency_code`` of its
    owners; the packers then need a ``mark``, by which a hot token is known as such to all its owners."""
    from pyspark.sql import functions as F

    def counted(table: pa.Table) -> list[np.ndarray]:
        """(owner, size, token, code) of the distinct pairs whose tokens two or more owners have."""
        kept: list[list[np.ndarray]] = [[np.zeros(0, dtype=kind)] for kind in (np.int64, np.int64, np.uint64, np.uint8)]
        for own, sizes, marks, token in unpack_parts(table, _PARTS):
            order = np.lexsort((own, token))
            t, o = token[order], own[order]
            new = np.concatenate([[True], t[1:] != t[:-1]])
            once = new | np.concatenate([[True], o[1:] != o[:-1]])
            start = np.flatnonzero(new)
            hot = np.bitwise_or.reduceat(marks[order], start) != 0
            n = np.add.reduceat(once, start, dtype=np.int64)  # owners of each token
            at = order[once & np.repeat(n > 1, np.diff(np.concatenate([start, [len(t)]])))]
            codes = np.repeat(np.where(hot, np.uint8(_HOT_CODE), frequency_code(n)), np.where(n > 1, n, 0))
            for c, v in zip(kept, (own[at], sizes[at], token[at], codes)):
                c.append(v)
        return [np.concatenate(c) for c in kept]

    def find(key: tuple, table: pa.Table) -> pa.Table:
        home = key[0].as_py()
        own, sizes, token, often = counted(table) if frequencies and home < buckets else (*(c for i, c in enumerate(unpack(table, wide)) if i != 2), None)
        if home < buckets and not frequencies:
            order, start, n = groups(token)
            o = own[order]
            if not len(o):
                return _OUT.empty_table()
            least = np.minimum.reduceat(o, start)
            keep = order[o > np.repeat(least, n) if later else np.repeat(least != np.maximum.reduceat(o, start), n)]
            own, sizes, token = own[keep], sizes[keep], token[keep]
        if often is None:  # salted pairs
            often = np.full(len(own) if frequencies else 0, _HOT_CODE, dtype=np.uint8)
        if not wide:
            token = token | (np.uint64(home % buckets & 0xFFFF) << np.uint64(48))
        if not len(own):
            return _OUT.empty_table()
        to = (mix(own.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((own, to))
        own, sizes, token, to = own[order], sizes[order], token[order], to[order]
        often = often[order] if frequencies else often
        cut = np.flatnonzero(np.diff(to)) + 1
        rows: list[list] = [[] for _ in _OUT.names]
        for a, b in zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(to)]])):
            new = np.concatenate([[0], np.flatnonzero(np.diff(own[a:b])) + 1])
            n = np.diff(np.concatenate([new, [b - a]])).astype(np.uint32)
            for c, v in zip(rows, (int(to[a]), own[a:b][new].tobytes(), sizes[a:b][new].tobytes(), n.tobytes(), token[a:b].tobytes(), often[a:b].tobytes())):
                c.append(v)
        return pa.table([pa.array(c, t) for c, t in zip(rows, _OUT.types)], schema=_OUT)

    def gather(table: pa.Table) -> pa.Table:
        def joined(c: str, kind) -> np.ndarray:
            return np.frombuffer(b"".join(table.column(c).to_pylist()), dtype=kind)

        own, sizes, counts, token = joined("owners", np.int64), joined("sizes", np.int64), joined("counts", np.uint32), joined("tokens", np.uint64)
        own, sizes = np.repeat(own, counts), np.repeat(sizes, counts)
        order = np.lexsort((token, own))
        own, token = own[order], token[order]
        if len(own):
            once = np.concatenate([[True], (own[1:] != own[:-1]) | (token[1:] != token[:-1])])
            order, own, token = order[once], own[once], token[once]
        start = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1]) if len(own) else np.zeros(0, dtype=np.int64)
        ends = np.concatenate([start[1:], [len(own)]]) if len(own) else start
        columns = [pa.array(own[start], pa.int64()), pa.array(sizes[order[start]], pa.int64()), pa.array([token[a:b].tobytes() for a, b in zip(start, ends)], pa.binary())]
        if frequencies:
            often = joined("often", np.uint8)[order]
            columns.append(pa.array([often[a:b].tobytes() for a, b in zip(start, ends)], pa.binary()))
        return pa.table(columns, names=["owner", "size", "tokens", "often"][: len(columns)])

    extra = ", often binary" if frequencies else ""
    _OUT = pa.schema([("bucket", pa.int64()), *[(c, pa.binary()) for c in ("owners", "sizes", "counts", "tokens", *(["often"] if frequencies else []))]])
    found = postings.groupBy("bucket").applyInArrow(find, "bucket long, owners binary, sizes binary, counts binary, tokens binary" + extra)
    return materialize(found.groupBy("bucket").applyInArrow(gather, "owner long, size long, tokens binary" + extra).where(F.length("tokens") > 0), name, codec="none")
