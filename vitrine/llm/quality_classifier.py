"""Quality classifier: similarity-weighted votes of the nearest labelled texts in a latent semantic space.

A text is a vector of hashed terms (word, last two bytes, shape and repetition of each word; logarithmic
counts times inverse document frequency) and of style terms (shares of repeated, all-capital, symbol and
letterless words over fixed steps). Document frequencies are counted over all documents. The latent
space is spanned by the leading right singular vectors of a bounded labelled sample; the sample's latent
vectors are broadcast, every document's cosine with every one of them is computed in blocks, and the
``NEIGHBOURS`` nearest vote with weight cosine ** ``POWER``.

Bound: the sample takes at most ``SAMPLE`` rows of each label, those with the least hash of their id, from
the rows that are not held out. Labels, language, source and id are no inputs of a score.

Defined cases: a null text counts as an empty one; a text without words is equally far from all and gets the
share of label 1 in the sample; no labelled rows give 0.5; a document labelled twice counts with its
lower label; rows repeated in the documents come out repeated; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.runtime import materialize, with_text
from vitrine.llm.textarrays import Words, batches, mix

#: Hashed term dimensions.
TERMS = 1024
#: Steps of a style share and weight of a style term.
STEPS = (0.005, 0.02, 0.05, 0.1, 0.2, 0.4)
STYLE = 0.35
SHARES = 4
DIMENSIONS = TERMS + SHARES * len(STEPS)
LATENT = 64
SAMPLE = 1500
NEIGHBOURS = 15
POWER = 8
#: Documents whose cosines a task holds at once.
ROWS = 512
THRESHOLD = 0.7

_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_SMALL = np.zeros(256, dtype=bool)
_SMALL[97:123] = True
_SMALL[128:] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "!#*$%&|<>"]] = True


def counts(w: Words) -> np.ndarray:
    """A row per text: counts of the hashed terms, then 0/1 style terms."""
    n_docs = len(w)
    out = np.zeros((n_docs, DIMENSIONS), dtype=np.float32)
    start, end, data = w.start, w.end, w.data
    if not len(start):
        return out
    h = w.hashes()
    doc = np.repeat(np.arange(n_docs), w.counts)
    last = data[end - 1].astype(np.uint64)
    before = np.where(end - start > 1, data[np.maximum(end - 2, 0)], 0).astype(np.uint64)
    upper = np.concatenate([[0], np.cumsum(_UPPER[data])])
    small = np.concatenate([[0], np.cumsum(_SMALL[data])])
    n_up, n_small = upper[end] - upper[start], small[end] - small[start]
    shape = np.select([n_up + n_small == 0, (n_small == 0) & (n_up > 1), n_small == 0, n_up == 0, _UPPER[data[start]] & (n_up == 1)], [0, 2, 1, 3, 4], 5)
    again = np.zeros(len(h), dtype=bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    terms = [h, mix(last * np.uint64(257) + before + np.uint64(1 << 20)), mix(shape.astype(np.uint64) + np.uint64(1 << 21)), mix(again.astype(np.uint64) + np.uint64(1 << 22))]
    for t in terms:
        at = doc * TERMS + (t % np.uint64(TERMS)).astype(np.int64)
        out[:, :TERMS] += np.bincount(at, minlength=n_docs * TERMS).reshape(n_docs, TERMS)
    total = np.maximum(w.counts, 1)
    for k, flag in enumerate((again, (n_small == 0) & (n_up > 0), _SYMBOL[last.astype(np.int64)], n_up + n_small == 0)):
        share = np.bincount(doc[flag], minlength=n_docs) / total
        out[:, TERMS + k * len(STEPS) : TERMS + (k + 1) * len(STEPS)] = share[:, None] > np.array(STEPS)
    return out


def weighted(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit vectors of the hashed terms with the style terms beside them, scaled to length 1."""
    v = np.log1p(c[:, :TERMS]) * idf
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    v = np.concatenate([v, c[:, TERMS:] * np.float32(STYLE)], axis=1).astype(np.float32)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def held_out(id_col: Column) -> Column:
    """Rows whose labels nothing is learnt from."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold each hashed term, and number of documents, over all rows."""

    def count(batch_iter):
        total, n = np.zeros(TERMS, dtype=np.int64), 0
        for b in batch_iter:
            for i, j, w in batches(b.column("text")):
                total += (counts(w)[:, :TERMS] > 0).sum(axis=0)
                n += j - i
        yield pa.record_batch([pa.array(range(TERMS + 1), pa.int32()), pa.array([*total.tolist(), n], pa.int64())], names=["term", "n"])

    rows = texts.select("text").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # TERMS + 1 rows
    found = np.zeros(TERMS + 1, dtype=np.int64)
    for term, n in rows:
        found[term] = n
    return found[:TERMS], int(found[TERMS])


class Model:
    """Latent space and labelled latent vectors; of fixed size, so fit for a broadcast."""

    def __init__(self, idf: np.ndarray, basis: np.ndarray, vectors: np.ndarray, labels: np.ndarray):
        self.idf, self.basis, self.vectors, self.labels = idf, basis, vectors, labels

    def project(self, c: np.ndarray) -> np.ndarray:
        z = weighted(c, self.idf) @ self.basis
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def score(self, c: np.ndarray, neighbours: int = NEIGHBOURS, power: int = POWER) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(c), 0.5)
        out = np.empty(len(c))
        for a in range(0, len(c), ROWS):
            z = self.project(c[a : a + ROWS])
            s = z @ self.vectors.T
            k = min(neighbours, s.shape[1])
            top = np.argpartition(-s, k - 1, axis=1)[:, :k]
            w = np.maximum(np.take_along_axis(s, top, 1), 1e-6).astype(np.float64) ** power
            out[a : a + ROWS] = np.where(np.abs(z).max(axis=1) < 1e-9, self.labels.mean(), (w * self.labels[top]).sum(axis=1) / w.sum(axis=1))
        return np.clip(out, 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, latent: int = LATENT) -> Model:
    texts = with_text(docs, id_col, text_col)
    found, n = _frequencies(texts)
    idf = (np.log((1 + n) / (1 + found)) + 0.1).astype(np.float32)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("label").alias("label"))
    chosen = None
    for v in (0, 1):
        part = known.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = materialize(chosen, "labelled-sample")

    def vectors(batch_iter):
        for b in batch_iter:
            for i, j, w in batches(b.column("text")):
                c = counts(w)
                yield pa.record_batch([b.column("doc_id").slice(i, j - i), b.column("label").slice(i, j - i), pa.array([x.tobytes() for x in c], pa.binary())], names=["doc_id", "label", "counts"])

    # at most 2 * sample rows of DIMENSIONS numbers
    rows = texts.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).mapInArrow(vectors, "doc_id long, label int, counts binary").orderBy("doc_id").collect()
    if not rows:
        return Model(idf, np.zeros((DIMENSIONS, 1), dtype=np.float32), np.zeros((0, 1), dtype=np.float32), np.zeros(0))
    x = weighted(np.stack([np.frombuffer(r[2], dtype=np.float32) for r in rows]), idf)
    _, axes = np.linalg.eigh(x.T @ x)
    model = Model(idf, np.ascontiguousarray(axes[:, -latent:]).astype(np.float32), np.zeros((0, 1)), np.array([r[1] for r in rows], dtype=float))
    z = x @ model.basis
    model.vectors = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
    return model


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, label_col))

    def run(batch_iter):
        for b in batch_iter:
            parts = [model.value.score(counts(w)) for _, _, w in batches(b.column("text"))]
            if parts:
                yield pa.record_batch([b.column("doc_id"), pa.array(np.concatenate(parts), pa.float64())], names=["doc_id", "score"])

    scored = with_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
