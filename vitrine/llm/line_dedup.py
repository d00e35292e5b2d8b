"""Line dedup: winnowing over line hashes finds runs of lines that stand earlier, which then go.

The lines of a text that hold a word are numbered. From every ``MIN_RUN`` consecutive ones the one with the
least hash (the last of equal ones) is selected: any repeated run of ``MIN_RUN`` lines selects the same
line at the same place, so repeats share fingerprints for certain. Fingerprints that stand in one place
only leave. The others are extended both ways over the lines that selected them: a run matches when all
its ``MIN_RUN`` lines are equal, its first place (smallest document id, then line) stays, and every line that
a later place covers is deleted. Adjoining runs overlap, so a longer repeat goes as a whole.

With ``least`` set, runs of fewer than ``MIN_RUN`` lines, single lines included, go as well when they weigh ``least`` or
more. A word weighs one for every started ``WORD_BYTES`` bytes, so scripts without spaces weigh by their length.
Every such run is its own fingerprint. The pipeline sets ``LEAST``. ``op4_line_dedup`` does not, as its SQL has runs of
``MIN_RUN`` lines only: there shorter repeats stay, whatever their length.

Defined cases: a null text counts as an empty one; lines without a word are neither counted nor deleted;
texts with fewer than ``MIN_RUN`` lines keep them all unless ``least`` is set; rows with the same id are one document (equal rows stay
equal); rows with a null id keep their text and are no one's first place; an empty table gives an empty
result. ``clean`` keeps every column of its input, whatever its name.

Scale: a row per selected line (about half of them) and, with ``least``, per heavy shorter run; hot lines are counted with map-side sums, and in the
joins they meet one row per key, which adaptive execution splits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.runtime import free_name, materialize, with_text
from vitrine.llm.textarrays import Words, batches, hash_spans, windows

MIN_RUN = 3
#: Weight from which a run of fewer lines goes, in the pipeline.
LEAST = 20
WORD_BYTES = 12


def _worded(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number) of all lines, and which of them hold a word."""
    start, end, doc = w.lines()
    return start, end, doc, np.searchsorted(w.start, end) > np.searchsorted(w.start, start)


def _weights(w: Words, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Weight of each line: one for every started ``WORD_BYTES`` bytes of a word."""
    total = np.concatenate([[0], np.cumsum(-(-(w.end - w.start) // WORD_BYTES))])
    return total[np.searchsorted(w.start, end)] - total[np.searchsorted(w.start, start)]


def winnow(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` hashes the position that it selects: its last least hash."""
    if len(h) < width:
        return np.zeros(0, dtype=np.int64)
    view = np.lib.stride_tricks.sliding_window_view(h, width)[:, ::-1]
    return np.arange(len(view)) + width - 1 - np.argmin(view, axis=1)


def later_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = MIN_RUN, least: int | None = None) -> DataFrame:
    """(doc_id, starts): where repeated runs start, as line number * ``run`` + lines of the run - 1."""

    def select(batch_iter):
        for b in batch_iter:
            ids = b.column("doc_id").to_pylist()
            rows: list[tuple] = []
            for i, _, w in batches(b.column("text")):
                start, end, doc, worded = _worded(w)
                h, d = hash_spans(w.data, start[worded], end[worded]), doc[worded]
                signed, whole = h.view(np.int64), windows(h, run).view(np.int64)
                cut = np.searchsorted(d, np.arange(len(w) + 1))
                for k in range(len(w)):
                    a, z = cut[k], cut[k + 1]
                    chosen = winnow(h[a:z], run)
                    if not len(chosen):
                        continue
                    edge = np.flatnonzero(np.diff(chosen)) + 1
                    for p, q in zip([0, *edge], [*edge, len(chosen)]):
                        rows.append((int(signed[a + chosen[p]]), ids[i + k], [s * run + run - 1 for s in range(p, q)], whole[a + p : a + q].tolist()))
                if least is None:
                    continue
                weight = np.concatenate([[0], np.cumsum(_weights(w, start[worded], end[worded]))])
                for size in range(1, run):
                    heavy = np.flatnonzero(weight[size:] - weight[:-size] >= least) if len(h) >= size else np.zeros(0, dtype=np.int64)
                    heavy = heavy[d[heavy] == d[heavy + size - 1]]
                    short = windows(h, size).view(np.int64)[heavy]
                    code = (heavy - cut[d[heavy]]) * run + size - 1
                    rows += [(x, ids[i + k], [c], [x]) for x, k, c in zip(short.tolist(), d[heavy].tolist(), code.tolist())]
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())))], names=["print", "doc_id", "starts", "runs"])

    texts = with_text(docs, id_col, text_col).where("doc_id is not null")
    prints = materialize(texts.mapInArrow(select, "print long, doc_id long, starts array<long>, runs array<long>"), "line-prints")
    shared = prints.groupBy("print").agg(F.count("*").alias("n")).where("n > 1").select("print")
    extended = prints.join(shared, "print", "left_semi").select("doc_id", F.explode(F.arrays_zip("starts", "runs")).alias("x"))
    extended = extended.select("doc_id", F.col("x.starts").alias("start"), F.col("x.runs").alias("run"))
    first = extended.groupBy("run").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = extended.join(first.select("run", "first"), "run").where(F.struct("doc_id", "start") > F.col("first"))
    return later.groupBy("doc_id").agg(F.sort_array(F.collect_set("start")).alias("starts"))


def _cutter(run: int):
    """Arrow function (text, starts) -> (text without the runs, lines with a word, lines deleted)."""

    def cut(texts: pa.Array, starts: pa.Array) -> pa.Array:
        out, n_lines, n_removed = [], [], []
        for i, _, w in batches(texts):
            start, end, doc, worded = _worded(w)
            bound = np.searchsorted(doc, np.arange(len(w) + 1))
            for k in range(len(w)):
                a, z = bound[k], bound[k + 1]
                own = np.flatnonzero(worded[a:z])
                n_lines.append(len(own))
                gone = np.zeros(0, dtype=np.int64)
                if starts[i + k].is_valid:
                    first, more = np.divmod(np.array(starts[i + k].as_py(), dtype=np.int64), run)
                    gone = own[np.unique((first[:, None] + np.arange(run))[np.arange(run) <= more[:, None]])]
                n_removed.append(len(gone))
                if not len(gone):
                    out.append(w.text(k).decode("utf-8"))
                    continue
                keep = np.ones(z - a, dtype=bool)
                keep[gone] = False
                out.append(b"\n".join(w.data[p:q].tobytes() for p, q in zip(start[a:z][keep], end[a:z][keep])).decode("utf-8"))
        return pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64())], names=["text", "n_lines", "n_removed"])

    return F.arrow_udf(cut, "text string, n_lines long, n_removed long")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = MIN_RUN, least: int | None = None) -> DataFrame:
    """doc_id, n_lines, n_removed, text (without the deleted lines) of every row."""
    runs = materialize(later_runs(docs, id_col, text_col, run, least), "later-runs")
    joined = with_text(docs, id_col, text_col).join(runs, "doc_id", "left")
    return joined.select("doc_id", _cutter(run)("text", "starts").alias("x")).select("doc_id", "x.n_lines", "x.n_removed", "x.text")


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", run: int = MIN_RUN, least: int | None = None, emptied: bool = True) -> DataFrame:
    """``docs`` with repeated runs deleted from the text; the length column follows where one is named and
    a line went. All other columns stay. Without ``emptied``, rows go whose text lost lines and has no word left."""
    runs = materialize(later_runs(docs, id_col, text_col, run, least), "later-runs")
    lost_id, starts = free_name(docs, "__line_dedup_id"), free_name(docs, "__line_dedup_starts")
    # one way to join at every size: texts are shuffled once, so disk grows in proportion to the input, and not sorted
    lost = runs.select(F.col("doc_id").alias(lost_id), F.col("starts").alias(starts)).hint("shuffle_hash")
    joined = docs.join(lost, docs[id_col] == F.col(lost_id), "left")
    cut = _cutter(run).asNondeterministic()  # as a filter on its result would run it once more
    left = F.when(F.col(starts).isNotNull(), cut(F.coalesce(docs[text_col], F.lit("")), F.col(starts))["text"])
    joined = joined.withColumn(text_col, F.coalesce(left, docs[text_col]))
    if chars_col in docs.columns:
        kind = docs.schema[chars_col].dataType
        joined = joined.withColumn(chars_col, F.when(F.col(starts).isNotNull(), F.length(F.col(f"`{text_col}`")).cast(kind)).otherwise(F.col(f"`{chars_col}`")))
    if not emptied:
        worded = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
        joined = joined.where(F.col(starts).isNull() | worded)
    return joined.drop(lost_id, starts)
