"""Best-fit packing: tokenized documents packed into sequences under three capacities at once.

A document's ids end with ``END``; one longer than ``TOKENS`` is cut into pieces of ``TOKENS`` ids of which the
first takes what is left over. Each piece has a demand vector (tokens, 1 document, attention cost =
length squared), a sequence a capacity vector. Pieces are placed in decreasing order of demand; a piece
goes to the open sequence that holds it under every capacity and is best by the weighted norm of the
residual that it would leave (``rule="norm"``) or by the weighted dot product of demand and residual
(``rule="dot"``); without one it opens a sequence. Full pieces are sequences of their own.

The other pieces are dealt by hash into blocks of about ``BLOCK`` pieces, each packed on its own, so a
task's memory is bounded and the waste of a block is a few part-filled sequences out of thousands.

Defined cases: a null or empty text is the single id ``END``; repeated rows are packed each; an empty
table gives an empty result; a piece that exceeds a capacity by itself (a low attention capacity) gets a
sequence alone; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.runtime import materialize, with_text
from vitrine.llm.textarrays import CHUNK, batches, hash_spans, ranges

TOKENS = 2048
END = 0
#: Pieces that one task packs together.
BLOCK = 20_000
#: Segments whose ids a worker remembers.
REMEMBERED = 1_000_000
#: Segments encoded at once.
ENCODED = 4096
#: Weights of the three residuals, each as a share of its capacity.
WEIGHTS = (1.0, 0.001, 0.001)
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of whole texts by a ``tokenizers`` file. A byte-level tokenizer of this family splits a text into
    pieces by a pattern before it merges bytes; where a piece ends for certain the text is cut, and equal
    segments are encoded once. Such places are: before a space and the visible character after it;
    between an ASCII letter and one of ``STOPS``; between a single line feed and an ASCII letter."""

    #: Punctuation that begins a piece after a letter, and that no special token holds.
    STOPS = ".,;:!?*$%&#()\""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._clear()
        #: Bytes before which a space is no certain cut: controls, spaces and lead bytes of Unicode spaces.
        self.unsafe = np.zeros(256, dtype=bool)
        self.unsafe[:0x21] = True
        self.unsafe[[0x7F, 0xC2, 0xE1, 0xE2, 0xE3]] = True
        self.letter = np.zeros(256, dtype=bool)
        self.letter[65:91] = self.letter[97:123] = True
        self.stop = np.zeros(256, dtype=bool)
        self.stop[[ord(c) for c in self.STOPS]] = True
        self.visible = np.zeros(256, dtype=bool)
        self.visible[0x21:0x7F] = True

    def _clear(self) -> None:
        self.hashes = np.zeros(0, dtype=np.uint64)
        self.at = np.zeros(0, dtype=np.int64)
        self.length = np.zeros(0, dtype=np.int64)
        self.pool, self.used = np.zeros(1 << 16, dtype=np.uint32), 0

    def _learn(self, hashes: np.ndarray, segments: list[str]) -> None:
        if len(self.hashes) + len(hashes) > REMEMBERED and len(self.hashes):
            self._clear()
        ids = []
        for a in range(0, len(segments), ENCODED):
            ids += [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(segments[a : a + ENCODED], add_special_tokens=False)]
        length = np.array([len(x) for x in ids], dtype=np.int64)
        flat = np.concatenate(ids)
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(flat)] = flat
        at = self.used + np.concatenate([[0], np.cumsum(length)[:-1]]).astype(np.int64)
        self.used += len(flat)
        place = np.searchsorted(self.hashes, hashes)
        self.hashes, self.at, self.length = np.insert(self.hashes, place, hashes), np.insert(self.at, place, at), np.insert(self.length, place, length)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, bounds of each text's ids). ``data`` holds the texts' UTF-8 bytes."""
        n = len(data)
        cut = np.zeros(n + 1, dtype=bool)
        if n > 1:
            cut[: n - 1] = (data[:-1] == 0x20) & ~self.unsafe[data[1:]]
            cut[np.maximum(offsets - 1, 0)] = False  # behind a text's last byte stands another text
            cut[1:n] |= self.letter[data[:-1]] & self.stop[data[1:]]
            cut[2:n] |= self.visible[data[:-2]] & (data[1:-1] == 0x0A) & self.letter[data[2:]]
        cut[offsets] = True
        edge = np.flatnonzero(cut)
        if n not in (edge[-1:].tolist() or [0]):
            edge = np.append(edge, n)
        start, end = edge[:-1], edge[1:]
        if not len(start):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(offsets), dtype=np.int64)
        hashes = hash_spans(data, start, end)
        unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(unique) + len(self.hashes) > REMEMBERED:
            self._clear()
        new = np.flatnonzero(~np.isin(unique, self.hashes, assume_unique=True))
        if len(new):
            raw = data.tobytes()
            self._learn(unique[new], [raw[a:b].decode("utf-8") for a, b in zip(start[first[new]], end[first[new]])])
        place = np.searchsorted(self.hashes, unique)[inverse]
        length = self.length[place]
        ids = self.pool[ranges(self.at[place], length)]
        return ids, np.concatenate([[0], np.cumsum(length)])[np.searchsorted(start, offsets)]


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """One encoder per worker process: tasks that share it share what it remembers."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens: int = TOKENS, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ``ids``, unsigned 32-bit little-endian) of every piece."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids

    def cut(batch_iter):
        encoder = _encoder(path or tokenizer_path())
        for b in batch_iter:
            docs_ids = b.column("doc_id").to_pylist()
            for i, _, w in batches(b.column("text"), chunk=CHUNK // 2):
                ids, bound = encoder.encode(w.data, w.offsets)
                rows: list[tuple] = []
                for k in range(len(w)):
                    own = np.append(ids[bound[k] : bound[k + 1]], np.uint32(END)).astype("<u4")
                    head = len(own) % tokens or tokens
                    edges = [0, *range(head, len(own) + 1, tokens)]
                    for p, (a, z) in enumerate(zip(edges, edges[1:])):
                        raw = own[a:z].tobytes()
                        rows.append((docs_ids[i + k], p, a, z - a, zlib.crc32(raw)) + ((raw,) if with_ids else ()))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return with_text(docs, id_col, text_col).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def place(lengths: np.ndarray, capacity: tuple[float, float, float], weights=WEIGHTS, rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of every piece, sequences numbered from 0 in the order they open."""
    demand = np.stack([lengths, np.ones(len(lengths)), lengths.astype(float) ** 2], axis=1) / np.array(capacity, dtype=float)
    order = np.lexsort((np.arange(len(lengths)), -lengths, -demand.max(axis=1))) if len(lengths) else np.zeros(0, dtype=int)
    w = np.array(weights)
    sequence, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    left = np.zeros((3, 1024))  # residual of the open sequences, one row per capacity
    number, filled = np.zeros(1024, dtype=np.int64), np.zeros(1024, dtype=np.int64)
    opened = live = 0
    smallest = demand.min(axis=0) if len(lengths) else np.zeros(3)
    slack = 1e-9
    for k, i in enumerate(order):
        d = demand[i]
        r = left[:, :live]
        fits = (r[0] >= d[0] - slack) & (r[1] >= d[1] - slack) & (r[2] >= d[2] - slack)
        at = np.flatnonzero(fits)
        if len(at):
            q = r[:, at]
            cost = ((q - d[:, None]) ** 2 * w[:, None]).sum(axis=0) if rule == "norm" else -(q * (d * w)[:, None]).sum(axis=0)
            j = at[int(np.argmin(cost))]
        else:
            if live == left.shape[1]:
                left = np.concatenate([left, np.zeros_like(left)], axis=1)
                number, filled = np.concatenate([number, np.zeros_like(number)]), np.concatenate([filled, np.zeros_like(filled)])
            j = live
            left[:, j], number[j], filled[j] = 1.0, opened, 0
            live, opened = live + 1, opened + 1
        sequence[i], offset[i] = number[j], filled[j]
        filled[j] += lengths[i]
        left[:, j] -= d
        if (left[:, j] < smallest - slack).any():  # nothing that is still to come fits: close it
            live -= 1
            left[:, j], number[j], filled[j] = left[:, live], number[live], filled[live]
    return sequence, offset


def pack(cut: DataFrame, tokens: int = TOKENS, documents: int = TOKENS, attention: float | None = None, rule: str = "norm", block: int = BLOCK) -> DataFrame:
    """``cut`` (a row per piece, with ``length``) and sequence_id, offset. ``cut`` has to be a stored table, as
    its rows are counted first. Capacities of a sequence: ``tokens``, ``documents`` and the sum of squared
    lengths ``attention`` (default: that of one full piece)."""
    attention = float(tokens) ** 2 if attention is None else float(attention)
    full = cut.where(F.col("length") == tokens).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    rest = cut.where(F.col("length") < tokens)
    blocks = max(1, -(-rest.count() // block))
    fields = list(cut.columns)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        order = np.lexsort([table.column(c).to_numpy() for c in ("start", "doc_id")])
        table = table.take(pa.array(order)).select(fields)
        sequence, offset = place(table.column("length").to_numpy(), (tokens, documents, attention), rule=rule)
        number = (np.int64(key[0].as_py()) << np.int64(32)) + sequence
        return table.append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(offset))

    by = rest.withColumn("block", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(blocks)))
    schema = ", ".join(f"`{c}` {t}" for c, t in cut.dtypes) + ", sequence_id long, offset long"
    return by.groupBy("block").applyInArrow(run, schema).unionByName(full)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens: int = TOKENS, path: str | None = None, with_ids: bool = False, **capacities) -> DataFrame:
    """Tokenize, cut and pack: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    stored = materialize(pieces(docs, id_col, text_col, tokens, path, with_ids), "pieces")
    return pack(stored, tokens, **capacities)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids (concatenated in order of offset) of pieces packed ``with_ids``; a sequence holds a
    bounded number of ids, so its rows fit in one group."""
    listed = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return listed.select("sequence_id", F.aggregate("p", F.expr("X''"), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
