"""Recompression of word sequences: rounds that name runs and pairs, and the words that fix each symbol.

A round names every run of equal symbols (block compression), then every adjacent pair whose first
symbol is in the left and whose second is in the right half of the alphabet (pair compression; the
halves are drawn by a hash of name and round). A name is a 64-bit hash of what it stands for, so the
same run or pair has the same name in every text, worker and round of a job.

``low[i]:high[i]`` are the words that decide symbol ``i``: its own and those neighbours that could
have made its run longer or paired with it. Wherever the same words stand, the same symbol stands.
"""

from __future__ import annotations

import numpy as np

from vitrine.llm.textarrays import mix

_RUN, _PAIR = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


class Symbols:
    """A level: name, first word, word after the last, deciding words and text number of each symbol."""

    __slots__ = ("name", "start", "end", "low", "high", "doc")

    def __init__(self, name, start, end, low, high, doc):
        self.name, self.start, self.end, self.low, self.high, self.doc = name, start, end, low, high, doc

    def __len__(self) -> int:
        return len(self.name)


def level0(hashes: np.ndarray, doc: np.ndarray) -> Symbols:
    at = np.arange(len(hashes), dtype=np.int64)
    return Symbols(hashes, at, at + 1, at, at + 1, doc)


def _context(s: Symbols) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Whether a symbol has a left and a right neighbour in its text, and how far these are decided.
    At a text's edge the deciding words reach outside, as another context could go on there."""
    same = s.doc[1:] == s.doc[:-1]
    left = np.concatenate([[False], same])
    right = np.concatenate([same, [False]])
    low = np.where(left, np.concatenate([s.low[:1], s.low[:-1]]), s.start - 1)
    high = np.where(right, np.concatenate([s.high[1:], s.high[-1:]]), s.end + 1)
    return left, right, low, high


def runs(s: Symbols) -> Symbols:
    """Block compression."""
    if not len(s):
        return s
    left, _, low, high = _context(s)
    first = ~(left & np.concatenate([[False], s.name[1:] == s.name[:-1]]))
    at = np.flatnonzero(first)
    last = np.concatenate([at[1:], [len(s)]]) - 1
    k = (last - at + 1).astype(np.uint64)
    name = np.where(k > 1, mix(s.name[at] * _RUN + k), s.name[at])
    return Symbols(name, s.start[at], s.end[last], np.minimum(low[at], s.low[at]), np.maximum(high[last], s.high[last]), s.doc[at])


def pairs(s: Symbols, number: int) -> Symbols:
    """Pair compression."""
    if not len(s):
        return s
    _, right, low, high = _context(s)
    in_left = (mix(s.name ^ mix(np.full(1, number + 1, dtype=np.uint64))) >> np.uint64(63)).astype(bool)
    head = in_left & right & np.concatenate([~in_left[1:], [False]])
    tail = np.concatenate([[False], head[:-1]])
    # a left symbol waits for what follows it, a right one for what precedes it
    low, high = np.where(in_left, s.low, np.minimum(low, s.low)), np.where(in_left, np.maximum(high, s.high), s.high)
    at = np.flatnonzero(~tail)
    mate = np.where(head[at], at + 1, at)
    name = np.where(head[at], mix(mix(s.name[at]) * _PAIR + s.name[mate]), s.name[at])
    paired = head[at]
    low = np.where(paired, np.minimum(s.low[at], s.low[mate]), low[at])
    high = np.where(paired, np.maximum(s.high[at], s.high[mate]), high[at])
    return Symbols(name, s.start[at], s.end[mate], low, high, s.doc[at])


def levels(hashes: np.ndarray, doc: np.ndarray, rounds: int) -> list[Symbols]:
    """Level 0 (words) and the level after each round."""
    out = [level0(hashes, doc)]
    for r in range(rounds):
        out.append(pairs(runs(out[-1]), r))
    return out
