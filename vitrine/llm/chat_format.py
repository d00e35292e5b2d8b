"""Chat formatting: a hidden Markov model finds the speaker of each transcript line, then turns are rendered.

A transcript is numbered lines. A line's observation is its speaker marker (user, assistant, system or
none), its length class and whether it ends as a question. The hidden state is a role, and whether the
line begins a turn or goes on with one. Start, transition and emission scores are logarithms of counted
shares (one added to every count) of labelled lines, rounded to integers; Viterbi gives the most likely
state sequence of each transcript, and the lines of a turn, without its marker, become one canonical
message.

Long transcripts: lines are cut into blocks of ``BLOCK``. A block's best score from each state before it to
each state at its end is a small matrix; a transcript's matrices (one row for ``BLOCK`` lines) are folded in
order, which fixes the states at all block ends; then every block finds its own path between fixed ends.
The result is a best path of the whole transcript, and no task holds one. Blocks are dealt by hash in
chunks of about ``CHUNK`` lines.

Defined cases: a null line is an empty one; lines without a conversation id or number belong to no
transcript and give nothing; lines that share a number are ordered by their text, and equal rows are
lines each; of equally good paths the one with the smaller states is taken; without labelled lines the
scores are those of the marker rules alone; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.runtime import materialize, parallelism

ROLES = ("system", "user", "assistant")
#: States: a role's first line, then a role's further lines.
STATES = 2 * len(ROLES)
#: The state before a transcript.
OUTSIDE = STATES
# Speaker markers at the start of a line.
MARKERS = {
    "system": r"(?i)^\s*(?:#+\s*)?(?:\*\*)?(?:system|instructions?)(?:\*\*)?\s*:(?:\*\*)?\s*",
    "user": r"(?i)^\s*(?:#+\s*)?(?:\*\*)?(?:user|human|customer|q|question|me|you)(?:\*\*)?\s*:(?:\*\*)?\s*",
    "assistant": r"(?i)^\s*(?:#+\s*)?(?:\*\*)?(?:assistant|ai|bot|agent|a|answer|model)(?:\*\*)?\s*:(?:\*\*)?\s*",
}
LENGTHS = (1, 40, 160)
SYMBOLS = 4 * (len(LENGTHS) + 1) * 2
BLOCK = 1024
CHUNK = 50_000
SCALE = 1_000
#: Most that the score of a turn's first line with another role's marker, or of a further line with any, can be.
WRONG_MARKER = -12 * SCALE


def marker(line: Column) -> Column:
    """0 none, else 1 + number of the role."""
    out = F.lit(0)
    for i, role in enumerate(ROLES):
        out = F.when(line.rlike(MARKERS[role]), i + 1).otherwise(out)
    return out


def symbol(line: Column) -> Column:
    """Observation of a line."""
    n = F.length(F.btrim(line))
    size = sum(((n >= k).cast("int") for k in LENGTHS[1:]), (n >= LENGTHS[0]).cast("int"))
    return (marker(line) * (len(LENGTHS) + 1) + size) * 2 + F.btrim(line).rlike(r"\?[\"')]*$").cast("int")


class Scores:
    """Integer log scores: ``step[a, b]`` from state a (or ``OUTSIDE``) to b, ``emit[b, symbol]``."""

    def __init__(self, transitions: np.ndarray, emissions: np.ndarray):
        def log(c: np.ndarray) -> np.ndarray:
            return np.rint(np.log(c / c.sum(axis=1, keepdims=True)) * SCALE).astype(np.int64)

        self.step, self.emit = log(transitions), log(emissions)
        per = SYMBOLS // 4
        for r in range(len(ROLES)):
            for other in range(len(ROLES)):
                if other != r:  # a turn hardly begins with another role's marker
                    block = self.emit[r, (other + 1) * per : (other + 2) * per]
                    np.minimum(block, WRONG_MARKER, out=block)
        further = self.emit[len(ROLES) :, per:]  # nor does a further line begin with a marker
        np.minimum(further, WRONG_MARKER, out=further)
        never = -(10**9)  # a further line follows only lines of its own role
        for a in range(STATES + 1):
            for r in range(len(ROLES)):
                if a == OUTSIDE or a % len(ROLES) != r:
                    self.step[a, len(ROLES) + r] = never


def _rules() -> tuple[np.ndarray, np.ndarray]:
    """Counts before any labelled line: one each, and more where a marker names its role."""
    emissions = np.ones((STATES, SYMBOLS))
    per = SYMBOLS // 4
    for r in range(len(ROLES)):
        emissions[r, (r + 1) * per : (r + 2) * per] += 10
        emissions[len(ROLES) + r, :per] += 10
    return np.ones((STATES + 1, STATES)), emissions


def fit(labelled: DataFrame) -> Scores:
    """Scores from lines with known ``state`` and ``before`` (the state of the line before, or ``OUTSIDE``) and
    ``symbol``. All lines are counted; what comes back has one row for each pair that occurs."""
    transitions, emissions = _rules()
    for a, b, n in labelled.groupBy("before", "state").agg(F.count("*")).collect():
        transitions[a, b] += n
    for b, s, n in labelled.groupBy("state", "symbol").agg(F.count("*")).collect():
        emissions[b, s] += n
    return Scores(transitions, emissions)


def _blocks(conv: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the runs of equal (conversation, block), longest run first."""
    cut = np.flatnonzero((conv[1:] != conv[:-1]) | (block[1:] != block[:-1])) + 1
    start = np.concatenate([[0], cut])
    size = np.diff(np.concatenate([start, [len(conv)]]))
    order = np.argsort(-size, kind="stable")
    return start[order], size[order]


def forward(scores: Scores, symbols: np.ndarray, start: np.ndarray, size: np.ndarray, entry: np.ndarray | None = None):
    """All blocks at once, a line of each at a time. Without ``entry``: best scores from every state before to
    every state at the end, (blocks, 7, 6). With it: states of all lines, for blocks entered from ``entry[:, 0]``
    that end in ``entry[:, 1]`` (or anywhere, if -1)."""
    n = len(start)
    emitted = scores.emit.T  # (symbol, state)
    if entry is None:
        v = scores.step[None, :, :] + emitted[symbols[start]][:, None, :]
        for t in range(1, int(size[0])):
            k = int(np.searchsorted(-size, -t, side="left"))
            v[:k] = (v[:k, :, :, None] + scores.step[None, None, :STATES, :]).max(axis=2) + emitted[symbols[start[:k] + t]][:, None, :]
        return v
    v = scores.step[entry[:, 0]] + emitted[symbols[start]]
    back = [np.zeros((n, STATES), dtype=np.int8)]
    for t in range(1, int(size[0])):
        k = int(np.searchsorted(-size, -t, side="left"))
        reach = v[:k, :, None] + scores.step[None, :STATES, :]
        back.append(reach.argmax(axis=1).astype(np.int8))
        v[:k] = reach.max(axis=1) + emitted[symbols[start[:k] + t]]
    states = np.zeros(len(symbols), dtype=np.int64)
    now = np.where(entry[:, 1] >= 0, entry[:, 1], v.argmax(axis=1))
    for t in range(int(size[0]) - 1, -1, -1):
        k = int(np.searchsorted(-size, -t, side="left")) if t else n
        states[start[:k] + t] = now[:k]
        if t:
            now[:k] = back[t][np.arange(k), now[:k]]
    return states


def fold(matrices: np.ndarray) -> np.ndarray:
    """(entry, exit) states of each block of one transcript, from its blocks' matrices in order."""
    n = len(matrices)
    v, back = matrices[0][OUTSIDE], np.zeros((n, STATES), dtype=np.int64)
    for i in range(1, n):
        reach = v[:, None] + matrices[i][:STATES]
        back[i], v = reach.argmax(axis=0), reach.max(axis=0)
    out = np.zeros((n, 2), dtype=np.int64)
    out[n - 1, 1] = int(v.argmax())
    for i in range(n - 1, 0, -1):
        out[i, 0] = out[i - 1, 1] = back[i, out[i, 1]]
    out[0, 0] = OUTSIDE
    return out


def decode(lines: DataFrame, scores: Scores, block: int = BLOCK) -> DataFrame:
    """(conv_id, line_no, line, state) of ``lines`` (conv_id, line_no, line)."""
    known = lines.where("conv_id is not null and line_no is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("line_no").cast("long").alias("line_no"), F.coalesce("line", F.lit("")).alias("line"))
    seen = materialize(known.withColumn("block", F.floor(F.col("line_no") / block)).withColumn("symbol", symbol(F.col("line"))), "transcript-lines")
    chunks = max(parallelism(lines.sparkSession), -(-seen.count() // CHUNK))
    held = lines.sparkSession.sparkContext.broadcast(scores)
    deal = F.pmod(F.xxhash64("conv_id", "block"), F.lit(chunks)).alias("chunk")

    def arranged(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
        table = table.sort_by([(c, "ascending") for c in ("conv_id", "block", "line_no", "line") if c in table.column_names])
        start, size = _blocks(table.column("conv_id").to_numpy(), table.column("block").to_numpy())
        return table, table.column("symbol").to_numpy(), start, size

    def measure(table: pa.Table) -> pa.Table:
        table, symbols, start, size = arranged(table)
        m = forward(held.value, symbols, start, size)
        at = pa.array(start)
        return pa.table([table.column("conv_id").take(at), table.column("block").take(at), pa.array([x.tobytes() for x in m], pa.binary())], names=["conv_id", "block", "matrix"])

    def join_blocks(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        ends = fold(np.stack([np.frombuffer(x.as_buffer(), dtype=np.int64).reshape(STATES + 1, STATES) for x in table.column("matrix")]))
        return pa.table([table.column("conv_id"), table.column("block"), pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["conv_id", "block", "entry", "exit"])

    def paths(table: pa.Table) -> pa.Table:
        table, symbols, start, size = arranged(table)
        entry = np.stack([table.column(c).to_numpy()[start] for c in ("entry", "exit")], axis=1)
        return table.select(["conv_id", "line_no", "line"]).append_column("state", pa.array(forward(held.value, symbols, start, size, entry)))

    long = seen.groupBy("conv_id").agg(F.min("block").alias("a"), F.max("block").alias("z")).where("a < z").select("conv_id")
    split = seen.join(long, "conv_id", "left_semi").select("conv_id", "block", "line_no", "line", "symbol", deal)
    matrices = split.groupBy("chunk").applyInArrow(measure, "conv_id long, block long, matrix binary")
    ends = materialize(matrices.groupBy("conv_id").applyInArrow(join_blocks, "conv_id long, block long, entry long, exit long"), "block-ends")
    dealt = seen.join(ends, ["conv_id", "block"], "left").select("conv_id", "block", "line_no", "line", "symbol", F.coalesce("entry", F.lit(OUTSIDE).cast("long")).alias("entry"), F.coalesce("exit", F.lit(-1).cast("long")).alias("exit"), deal)
    return dealt.groupBy("chunk").applyInArrow(paths, "conv_id long, line_no long, line string, state long")


def render(decoded: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, first_line, role, n_lines, message: a row per turn. A turn's lines meet by the number of its
    first line: the last beginning at or before a line, from its own block or from the blocks before."""
    lines = materialize(decoded.withColumn("block", F.floor(F.col("line_no") / block)), "decoded-lines")
    ends = lines.groupBy("conv_id", "block").agg(F.max(F.when(F.col("state") < len(ROLES), F.col("line_no"))).alias("last"), F.min("line_no").alias("least"))
    whole = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("conv_id", "block", "least", F.max("last").over(whole).alias("carried"))
    within = Window.partitionBy("conv_id", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.join(ends, ["conv_id", "block"]).withColumn("own", F.max(F.when(F.col("state") < len(ROLES), F.col("line_no"))).over(within))
    marked = marked.withColumn("first_line", F.coalesce("own", "carried", "least"))
    role = F.element_at(F.array(*[F.lit(r) for r in ROLES]), (F.col("state") % len(ROLES) + 1).cast("int"))
    text = F.col("line")
    for r in ROLES:
        text = F.when(F.col("state") < len(ROLES), F.regexp_replace(text, MARKERS[r], "")).otherwise(text)
    turns = marked.select("conv_id", "first_line", "line_no", role.alias("role"), text.alias("text")).groupBy("conv_id", "first_line").agg(
        F.min_by("role", "line_no").alias("role"), F.count("*").alias("n_lines"), F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias("parts")
    )
    body = F.regexp_replace(F.array_join(F.transform("parts", lambda p: p["text"]), "\n"), r"\s+$", "")
    return turns.select("conv_id", "first_line", "role", "n_lines", F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), body, F.lit("<|im_end|>")).alias("message"))


# The tables hold turns, not transcripts: these are written out as lines, with the markers of a style that
# depends on the conversation, some left out.

STYLES = (("System: ", "User: ", "Assistant: "), ("### System: ", "**Human**: ", "**AI**: "), ("Instructions: ", "Q: ", "A: "))


def derived_transcripts(conversations: DataFrame, block: int = 256) -> DataFrame:
    """conv_id, line_no, line, and the truth: role, begins. One turn in ten has no marker."""
    turns = conversations.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.coalesce("role", F.lit("user")).alias("role"), F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    style = F.pmod("conv_id", F.lit(len(STYLES)))
    prefix = F.lit("")
    for k, names in enumerate(STYLES):
        for r, p in zip(ROLES, names):
            prefix = F.when((style == k) & (F.col("role") == r), p).otherwise(prefix)
    bare = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(10)) == 0
    turns = turns.withColumn("prefix", F.when(bare, "").otherwise(prefix)).withColumn("block", F.floor(F.col("turn") / block)).withColumn("n", F.size("lines"))
    # the number of a turn's first line: lines of earlier blocks, then of earlier turns of its own block
    sums = turns.groupBy("conv_id", "block").agg(F.sum("n").alias("n"))
    before = sums.select("conv_id", "block", F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    own = Window.partitionBy("conv_id", "block").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    numbered = turns.join(before, ["conv_id", "block"]).withColumn("at", F.col("offset") + F.coalesce(F.sum("n").over(own), F.lit(0)))
    lines = numbered.select("conv_id", "turn", "role", "prefix", "at", F.posexplode("lines").alias("i", "line"))
    return lines.select("conv_id", (F.col("at") + F.col("i")).alias("line_no"), F.when(F.col("i") == 0, F.concat("prefix", "line")).otherwise(F.col("line")).alias("line"), "role", (F.col("i") == 0).alias("begins"), "turn", "i")


def labelled(transcripts: DataFrame) -> DataFrame:
    """``state``, ``before`` and ``symbol`` of derived lines: what precedes a line is known from the turns."""
    number = F.coalesce(F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.col("role")), F.lit(2)).cast("int") - 1
    rows = transcripts.withColumn("r", F.when(number < 0, 1).otherwise(number))
    state = F.when(F.col("begins"), F.col("r")).otherwise(F.col("r") + len(ROLES))
    rows = rows.select("conv_id", "line_no", state.alias("state"), symbol(F.col("line")).alias("symbol"))
    last = rows.select("conv_id", (F.col("line_no") + 1).alias("line_no"), F.col("state").alias("before"))
    return rows.join(last, ["conv_id", "line_no"], "left").select("state", F.coalesce("before", F.lit(OUTSIDE)).alias("before"), "symbol")


def held_out(conv_id: Column) -> Column:
    """Conversations that the scores are not learnt from."""
    return F.coalesce(F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
