"""Target-distribution importance resampling over hashed word n-grams.

Words are runs of digits, a-z and non-ASCII characters after lower-casing A-Z. A document's features are its
runs of one to two words, joined by one space; each falls into a bucket by its CRC-32. A bucket's gain is
the log ratio of its smoothed shares among the target's and the corpus's features, a document's weight the
floored mean of its features' gains, and its score the weight plus Gumbel noise drawn from its id, so that
taking the highest scores is drawing without replacement by weight.

Scores are made on arrays: a batch's words are found and hashed byte column by byte column, a pair's
CRC-32 follows from its words' by shifting the first one's past the second (a linear map, tabled by length).
The cutoff is found by weighted median of medians: each partition gives the median of its remaining keys
and their number; the median of these medians, weighted by the numbers, has at least a quarter of all
remaining keys on either side, so each round discards at least a quarter (about half, as a rule) until the
cutoff is the pivot itself. Winners, known by comparison with the cutoff, are sorted.

Defined cases: null texts have no words; documents without features weigh 0; documents under the least
number of words are scored and not drawn; a null id is hashed as an empty one and comes last among
ties; repeated rows are rows of their own, drawn in the order in which they were stored; an empty corpus or
target is smoothed like any other (empty: no rows). Other columns of the input are not read.

Scale: two scans of the texts. A task passes on one row per bucket it saw (10,000 at most), the gains are one
array of as many numbers. A selection round reads the stored keys (24 bytes a document) and sends the
driver one row per partition. No row meets another but in the sort of the winners.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.ordinals import with_ordinals
from vitrine.llm.runtime import materialize
from vitrine.llm.textarrays import batches

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 25
SEED = 7

#: Longest word, in bytes, that is hashed column by column; longer ones are hashed one by one.
COLUMNS = 40

_WORD = np.zeros(256, dtype=bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


def _byte_step(x: np.ndarray) -> np.ndarray:
    """CRC-32 registers after one zero byte."""
    for _ in range(8):
        x = (x >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (x & np.uint32(1)))
    return x


_CRC = _byte_step(np.arange(256, dtype=np.uint32))


def _shift_tables() -> np.ndarray:
    """[length, byte of the register, value]: what ``length`` zero bytes make of it."""
    at = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    out = [at]
    for _ in range(COLUMNS):
        at = _CRC[at & np.uint32(0xFF)] ^ (at >> np.uint32(8))
        out.append(at)
    return np.stack(out)


_SHIFT = _shift_tables()
_SPACE = np.uint32(zlib.crc32(b" "))


def crc_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of byte spans."""
    size = end - start
    order = np.argsort(-np.minimum(size, COLUMNS + 1).astype(np.int16), kind="stable")
    lengths, begin = size[order], start[order]
    state = np.full(len(order), 0xFFFFFFFF, dtype=np.uint32)
    longer = int(np.searchsorted(-lengths.clip(max=COLUMNS + 1), -COLUMNS, side="left"))
    live = np.searchsorted(-lengths[longer:], -np.arange(COLUMNS), side="left") + longer
    for j in range(COLUMNS):
        a, z = longer, int(live[j])
        if a >= z:
            break
        s = state[a:z]
        state[a:z] = _CRC[(s ^ data[begin[a:z] + j]) & np.uint32(0xFF)] ^ (s >> np.uint32(8))
    state ^= np.uint32(0xFFFFFFFF)
    for k in range(longer):
        state[k] = zlib.crc32(data[begin[k] : begin[k] + lengths[k]])
    out = np.empty(len(order), dtype=np.uint32)
    out[order] = state
    return out


def crc_pairs(data: np.ndarray, start: np.ndarray, end: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """CRC-32 of each span, a space and the next span (one less than there are spans)."""
    first = crc[:-1]
    first = _SHIFT[1, 0][first & 0xFF] ^ _SHIFT[1, 1][first >> 8 & 0xFF] ^ _SHIFT[1, 2][first >> 16 & 0xFF] ^ _SHIFT[1, 3][first >> 24] ^ _SPACE
    size = (end - start)[1:]
    n = np.minimum(size, COLUMNS)
    out = crc[1:].copy()
    for byte in range(4):
        out ^= _SHIFT[n, byte, first >> np.uint32(8 * byte) & np.uint32(0xFF)]
    for k in np.flatnonzero(size > COLUMNS):
        out[k] = zlib.crc32(data[start[k + 1] : end[k + 1]], int(first[k]))
    return out


def features(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, words of each text, buckets of its words, buckets of its pairs, pairs that are in one text)
    of consecutive texts."""
    for i, j, w in batches(texts, lower=True):
        inside = np.zeros(len(w.data) + 2, dtype=np.int8)
        inside[1:-1] = _WORD[w.data]
        # a text that ends within a run of word bytes ends its word
        joins = w.offsets[1:-1]
        joins = np.unique(joins[(joins > 0) & (joins < len(w.data))])
        joins = joins[(inside[joins] & inside[joins + 1]).astype(bool)]
        change = np.diff(inside)
        start = np.sort(np.concatenate([np.flatnonzero(change == 1), joins]))
        end = np.sort(np.concatenate([np.flatnonzero(change == -1), joins]))
        cut = np.searchsorted(start, w.offsets)
        n = np.diff(cut)
        crc = crc_spans(w.data, start, end)
        same = np.ones(max(len(start) - 1, 0), dtype=bool)
        same[cut[(cut > 0) & (cut < len(start))] - 1] = False
        pairs = crc_pairs(w.data, start, end, crc) if len(start) else crc
        yield i, n, (crc % BUCKETS).astype(np.int64), (pairs % BUCKETS).astype(np.int64), same


def bucket_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(bucket, n): features of all texts by bucket."""

    def count(batch_iter):
        total = np.zeros(BUCKETS, dtype=np.int64)
        for b in batch_iter:
            for _, _, words, pairs, same in features(b.column(0)):
                total += np.bincount(words, minlength=BUCKETS) + np.bincount(pairs[same], minlength=BUCKETS)
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], names=["bucket", "n"])

    return texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, text_col: str = "text", target_text_col: str = "text") -> np.ndarray:
    """Gain of each bucket, in thousandths of a nat, rounded down."""

    def read(df: DataFrame) -> np.ndarray:
        out = np.zeros(BUCKETS, dtype=np.int64)
        for bucket, n in df.collect():  # a row per bucket
            out[bucket] = n
        return out

    s, t = read(bucket_counts(corpus, text_col)), read(bucket_counts(target, target_text_col))
    up, down = float(s.sum() + BUCKETS), float(t.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((float(a) + 1) * up / ((float(b) + 1) * down))) for a, b in zip(t, s)], dtype=np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row."""
    told = docs.sparkSession.sparkContext.broadcast(gain)

    def score(batch_iter):
        for b in batch_iter:
            ids, texts = b.column(0), b.column(1)
            for i, n, words, pairs, same in features(texts):
                edge = np.concatenate([[0], np.cumsum(n)])
                one = np.concatenate([[0], np.cumsum(told.value[words])])
                two = np.concatenate([[0], np.cumsum(np.where(same, told.value[pairs], 0))])
                # pair k is that of words k and k + 1; a text's pairs end before its last word
                total = np.diff(one[edge]) + np.where(n > 1, two[np.maximum(edge[1:] - 1, 0)] - two[np.minimum(edge[:-1], len(two) - 1)], 0)
                count = n + np.maximum(n - 1, 0)
                weight = np.where(count > 0, total // np.maximum(count, 1), 0)
                yield pa.record_batch([ids.slice(i, len(n)), pa.array(n, pa.int64()), pa.array(count, pa.int64()), pa.array(weight, pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    weighed = texts.mapInArrow(score, "doc_id long, n_words long, n_features long, weight long")
    digits = F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    return weighed.withColumn("score", F.col("weight") + noise)


def cutoff(keys: DataFrame, k: int) -> tuple[int, int, int] | None:
    """The ``k``-th key of (score descending, tie, row ascending); None for ``k`` = 0.

    One pass a round: with the last round's pivot, each partition tells for both sides of it how many keys
    remain there and their median, so the side can be chosen and the next pivot taken from one answer.
    """
    if k <= 0:
        return None
    schema = "side int, n long, score long, tie long, row long"

    def answer(lo, hi, pivot):
        """Keys are compared as (-score, tie, row); lo < remaining < hi."""

        def below(a: np.ndarray, key) -> np.ndarray:
            x, y, z = a
            return (x < key[0]) | (x == key[0]) & ((y < key[1]) | (y == key[1]) & (z < key[2]))

        def run(batch_iter):
            kept = []
            for b in batch_iter:
                a = np.stack([-b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()])
                if hi is not None:
                    a = a[:, below(a, hi)]
                if lo is not None:
                    a = a[:, ~below(a, lo) & (a != np.array(lo)[:, None]).any(axis=0)]
                kept.append(a)
            a = np.concatenate(kept, axis=1) if kept else np.zeros((3, 0), dtype=np.int64)
            less = below(a, pivot) if pivot is not None else np.ones(a.shape[1], dtype=bool)
            more = ~less & (a != np.array(pivot)[:, None]).any(axis=0) if pivot is not None else ~less
            rows = []
            for side, part in ((0, a[:, less]), (1, a[:, more])):
                n = part.shape[1]
                if n:
                    middle = part[:, np.lexsort(part[::-1])[(n - 1) // 2]]
                    rows.append((side, n, *map(int, middle)))
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), *[pa.int64()] * 4))], names=["side", "n", "score", "tie", "row"])

        return run

    lo = hi = pivot = None
    narrow = keys.select("score", "tie", "row")
    while True:
        rows = narrow.mapInArrow(answer(lo, hi, pivot), schema).collect()  # two rows a partition at most
        sides = [sorted(((r.score, r.tie, r.row), r.n) for r in rows if r.side == s) for s in (0, 1)]
        less = sum(n for _, n in sides[0])
        if pivot is not None:
            if k == less + 1:
                return -pivot[0], pivot[1], pivot[2]
            if k <= less:
                hi = pivot
            else:
                lo, k = pivot, k - less - 1
        left = sides[0] if pivot is None or hi == pivot else sides[1]
        total, run = sum(n for _, n in left), 0
        if k > total:
            raise ValueError("fewer keys than are to be drawn")
        for key, n in left:
            run += n
            if 2 * run >= total:
                pivot = key
                break


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank, n_words of every row; rank is null where it isn't drawn."""
    gain = gains(docs, target, text_col, target_text_col)
    scored = weigh(docs, gain, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    tie = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    scored = materialize(scored.withColumn("tie", tie), "importance-scores")
    long_enough = F.col("n_words") >= least_words
    k = percent * scored.where(long_enough).count() // 100
    last = cutoff(scored.where(long_enough), k)
    out = ["doc_id", "n_features", "weight", "score"]
    if last is None:
        return scored.select(*out, F.lit(None).cast("long").alias("rank"), "n_words")
    drawn = long_enough & (F.struct(-F.col("score"), F.col("tie"), F.col("row")) <= F.struct(F.lit(-last[0]).cast("long"), F.lit(last[1]).cast("long"), F.lit(last[2]).cast("long")))
    ranked = with_ordinals(scored.where(drawn), [F.col("score").desc(), F.col("tie").asc(), F.col("row").asc()])
    return ranked.select(*out, (F.col("ordinal") + 1).alias("rank"), "n_words").unionByName(scored.where(~drawn).select(*out, F.lit(None).cast("long").alias("rank"), "n_words"))
