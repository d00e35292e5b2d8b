"""Numpy view of a batch of texts: words, 64-bit word hashes and hashes of word windows.

All work runs on the UTF-8 bytes of whole texts, some MB at a time, so memory does not depend on how
many texts a batch holds. A single text is never cut. Hashes are pure functions of the content and
equal in every worker.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at a time (a longer single text is taken whole).
CHUNK = 1 << 21

_SEP = np.zeros(256, dtype=bool)
_SEP[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Splitmix64 finaliser: a bijection that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_POW = np.ones(1, dtype=np.uint64)
_INV = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the odd step and of its inverse modulo 2**64."""
    global _POW, _INV
    if len(_POW) <= n:
        size = max(n + 1, 2 * len(_POW), 1 << 12)
        step = np.full(size, _STEP)
        inv = np.full(size, np.uint64(pow(int(_STEP), -1, 1 << 64)))
        step[0] = inv[0] = 1
        _POW, _INV = np.multiply.accumulate(step), np.multiply.accumulate(inv)
    return _POW, _INV


class Words:
    """Words of consecutive texts. ``first[i]:first[i + 1]`` are the words of text ``i``; word ``j`` is
    the bytes ``start[j]:end[j]`` of ``data``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self._hash: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @cached_property
    def _bounds(self) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.data)
        inside = ~_SEP[self.data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[self.offsets] = True
        left = np.ones(n, dtype=bool)
        left[1:] = ~inside[:-1]
        right = np.ones(n, dtype=bool)
        right[:-1] = ~inside[1:]
        return np.flatnonzero(inside & (left | edge[:-1])), np.flatnonzero(inside & (right | edge[1:])) + 1

    @property
    def start(self) -> np.ndarray:
        return self._bounds[0]

    @property
    def end(self) -> np.ndarray:
        return self._bounds[1]

    @cached_property
    def first(self) -> np.ndarray:
        return np.searchsorted(self.start, self.offsets)

    @cached_property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, text number) of every line of every text; an empty text is one empty line."""
        at = np.flatnonzero(self.data == 0x0A)
        start = np.sort(np.concatenate([self.offsets[:-1], at + 1]), kind="stable")
        end = np.sort(np.concatenate([at, self.offsets[1:]]), kind="stable")
        # a text's own start comes before the starts behind its line feeds, also when they are equal to
        # the next text's: count the line feeds of each text instead of searching
        n = np.diff(np.searchsorted(at, self.offsets)) + 1
        return start, end, np.repeat(np.arange(len(self)), n)

    def hashes(self) -> np.ndarray:
        """One 64-bit hash per word."""
        if self._hash is None:
            self._hash = hash_spans(self.data, self.start, self.end)
        return self._hash

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def joined(w: Words, keep: np.ndarray) -> pa.Array:
    """Each text's words that ``keep`` marks, joined by one space."""
    n = len(w.data)
    out = np.zeros(n + 1, dtype=bool)
    data = np.append(w.data, np.uint8(0x20))
    start, end = w.start[keep], w.end[keep]
    edge = np.zeros(n + 2, dtype=np.int32)
    np.add.at(edge, start, 1)
    np.add.at(edge, end, -1)
    out |= np.cumsum(edge[: n + 1]) > 0
    doc = np.searchsorted(w.first, np.flatnonzero(keep), side="right") - 1
    inner = end[:-1][doc[1:] == doc[:-1]] if len(doc) else end[:0]
    out[inner] = True  # the separator after a word that another kept word follows
    data[inner] = 0x20
    sizes = np.concatenate([[0], np.cumsum(out)])[w.offsets]
    return pa.Array.from_buffers(pa.string(), len(w), [None, pa.py_buffer(sizes.astype(np.int32).tobytes()), pa.py_buffer(data[out].tobytes())])


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of byte spans, from prefix sums modulo 2**64."""
    power, inverse = _powers(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` consecutive hashes, whatever text they are from (``len - width + 1``)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    if width <= 8:
        acc = hashes[:n].copy()
        for j in range(1, width):
            acc *= _STEP
            acc += hashes[j : j + n]
        return mix(acc)
    power, inverse = _powers(len(hashes))
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(mix(hashes ^ _BASE) * power[: len(hashes)], out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * inverse[:n])


def batches(texts: pa.Array, lower: bool = False, chunk: int = CHUNK) -> Iterator[tuple[int, int, Words]]:
    """(from, to, words) of consecutive texts of about ``chunk`` bytes together. Null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + chunk, side="right")) - 1)
        part = data[offsets[i] : offsets[j]]
        yield i, j, Words(_LOWER[part] if lower else part, offsets[i : j + 1] - offsets[i])
        i = j


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenation of ``arange(start, start + count)``."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    jump = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return jump + np.arange(total)
