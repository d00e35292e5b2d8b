"""Merkle manifest of a dataset as postorder append logs of ternary trees.

A leaf is the SHA-256 of a document's columns. The leaves of a source, by id, are cut into aligned blocks of
``3**HEIGHT``; a builder appends a block's leaves to its segment of the log and each inner node as soon as
its last child stands there, so a segment is the block's nodes in postorder, its root last. The roots of a
source's blocks are the leaves of the next tier, built alike, until one node, the subroot, is left; the
subroots by source are the leaves of one more tree, whose last node is the root.

Positions in the log are closed-form: after ``m`` leaves all complete subtrees hold ``m + m//3 + m//9 + ...``
nodes, so the node at level ``l`` that ends with leaf ``m - 1`` stands ``l`` behind that leaf's own place, and
the nodes of an incomplete right edge follow all others, lowest first. Proofs take siblings from these
places; no pointers are stored. Block roots get their proofs from the next tier, and hand them down.

Defined cases: null columns count as ``-``; a null source is a source and comes first; null ids come first
within a source; rows with equal ids follow in the order of their leaves, repeated rows are leaves of their
own; a run of one node is hashed like any other; a source of one document is its own subroot; an empty
table has an empty result. Columns other than the five are not read, whatever their names.

Scale: a leaf is 64 characters, texts are read once and not shuffled. Blocks are bounded, so a source with a
third of all rows is many blocks. Tiers shrink by 243 each. A proof is made where its block is read and
leaves as a hash. The driver sees each tier's greatest count and the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.ordinals import with_ordinals
from vitrine.llm.runtime import materialize

#: Children of a node, and levels that a builder makes of one block.
FAN = 3
HEIGHT = 5
BLOCK = FAN**HEIGHT

SEGMENT = "grp string, n long, block long, digests array<string>, ids array<long>, others array<string>"
STEP = "array<struct<place:int,run:array<string>>>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def complete(leaves: int) -> int:
    """Nodes of all complete subtrees over the first ``leaves`` leaves."""
    total = 0
    while leaves:
        total += leaves
        leaves //= FAN
    return total


def position(level: int, index: int, leaves: int) -> int:
    """Place in postorder of a node of the tree over ``leaves`` leaves."""
    width = FAN**level
    end = (index + 1) * width
    if end <= leaves:
        return complete(end - 1) + level
    lowest = 1  # the lowest level whose last node is not complete
    while leaves % FAN**lowest == 0:
        lowest += 1
    return complete(leaves) + level - lowest


def height(leaves: int) -> int:
    """Levels above the leaves until one node is left."""
    h = 0
    while FAN**h < leaves:
        h += 1
    return h


def append_log(leaves: list[str], levels: int) -> Iterator[str]:
    """Nodes of ``levels`` levels over the leaves, in the order in which they are complete."""
    open_runs: list[list[str]] = [[] for _ in range(levels + 1)]

    def put(level: int, node: str) -> Iterator[str]:
        yield node
        if level < levels:
            open_runs[level].append(node)
            if len(open_runs[level]) == FAN:
                yield from close(level)

    def close(level: int) -> Iterator[str]:
        run, open_runs[level] = open_runs[level], []
        yield from put(level + 1, digest("".join(run)))

    for leaf in leaves:
        yield from put(0, leaf)
    for level in range(levels):
        if open_runs[level]:
            yield from close(level)


def path(digests: list[str], leaves: int, levels: int, index: int) -> list[tuple[int, list[str]]]:
    """(place in its run, siblings left to right) of the leaf ``index`` and its ancestors, from their places."""
    out = []
    for level in range(levels):
        first, count = index - index % FAN, -(-leaves // FAN**level)
        run = [i for i in range(first, min(first + FAN, count)) if i != index]
        out.append((index - first, [digests[position(level, i, leaves)] for i in run]))
        index //= FAN
    return out


def fold(node: str, steps: list[tuple[int, list[str]]]) -> str:
    """The root that ``node`` and the siblings of a path lead to."""
    for place, run in steps:
        node = digest("".join([*run[:place], node, *run[place:]]))
    return node


def levels_of(n: int) -> int:
    """Levels of a block's segment in a group of ``n`` leaves."""
    return HEIGHT if n > BLOCK else height(n)


def leaf(columns: list[Column]) -> Column:
    """Hash of columns: each its UTF-8 byte count, a colon and the value, or ``-`` for null."""
    parts = []
    for c in columns:
        c = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def tier(leaves: DataFrame, name: str) -> DataFrame:
    """Segments over (grp, n, ordinal, id, digest, other)."""

    def build(key, rows):
        grp, block = (k.as_py() for k in key)
        rows = rows.sort_by("ordinal")
        n = rows.column("n")[0].as_py()
        nodes = list(append_log(rows.column("digest").to_pylist(), levels_of(n)))
        return pa.table({
            "grp": pa.array([grp], pa.string()), "n": pa.array([n], pa.int64()), "block": pa.array([block], pa.int64()),
            "digests": pa.array([nodes], pa.list_(pa.string())), "ids": pa.array([rows.column("id").to_pylist()], pa.list_(pa.int64())),
            "others": pa.array([rows.column("other").to_pylist()], pa.list_(pa.string())),
        })

    blocks = leaves.withColumn("block", F.floor(F.col("ordinal") / BLOCK)).groupBy("grp", "block")
    return materialize(blocks.applyInArrow(build, SEGMENT), name)


def forest(leaves: DataFrame, name: str) -> list[DataFrame]:
    """Segments of each tier over the leaves of all groups, lowest tier first."""
    tiers = [tier(leaves, f"{name}-1")]
    while (tiers[-1].agg(F.max("n")).first()[0] or 0) > BLOCK:
        roots = tiers[-1].where(F.col("n") > BLOCK)
        roots = roots.select("grp", F.ceil(F.col("n") / BLOCK).alias("n"), F.col("block").alias("ordinal"), F.lit(None).cast("long").alias("id"), F.element_at("digests", -1).alias("digest"), F.lit(None).cast("string").alias("other"))
        tiers.append(tier(roots, f"{name}-{len(tiers) + 1}"))
    return tiers


def tops(tiers: list[DataFrame]) -> DataFrame:
    """(grp, tier, digest): each group's last node and the tier in which it is made."""
    made = [t.where(F.col("n") <= BLOCK).select("grp", F.lit(i).alias("tier"), F.element_at("digests", -1).alias("digest")) for i, t in enumerate(tiers)]
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out


def _with_rest(segments: DataFrame, rest: DataFrame) -> DataFrame:
    """Segments with the steps above their block's root and the subroot."""
    above = rest.select(F.col("grp").alias("_grp"), F.col("block").alias("_block"), "steps", "subroot")
    return segments.join(above, segments["grp"].eqNullSafe(F.col("_grp")) & (segments["block"] == F.col("_block"))).drop("_grp", "_block")


def _paths(batch_iter):
    """Steps of each leaf of a segment, with those above it."""
    for b in batch_iter:
        for row in b.to_pylist():
            m, levels = min(BLOCK, row["n"] - row["block"] * BLOCK), levels_of(row["n"])
            for i in range(m):
                steps = [{"place": p, "run": run} for p, run in path(row["digests"], m, levels, i)] + row["steps"]
                yield pa.RecordBatch.from_pylist([{"grp": row["grp"], "block": row["block"] * BLOCK + i, "steps": steps, "subroot": row["subroot"]}], schema=_PATH)


_PATH = pa.schema([("grp", pa.string()), ("block", pa.int64()), ("steps", pa.list_(pa.struct([("place", pa.int32()), ("run", pa.list_(pa.string()))]))), ("subroot", pa.string())])


def paths(tiers: list[DataFrame], above: DataFrame) -> DataFrame:
    """The lowest tier's segments with ``steps`` above their roots; ``above`` has (grp, tier, steps, subroot)
    of each group."""
    rest = None
    for i in range(len(tiers) - 1, -1, -1):
        own = above.where(F.col("tier") == i).select("grp", F.lit(0).cast("long").alias("block"), "steps", "subroot")
        rest = own if rest is None else own.unionByName(rest)
        joined = _with_rest(tiers[i], rest)
        if i:
            rest = joined.drop("ids", "others").mapInArrow(_paths, f"grp string, block long, steps {STEP}, subroot string")
    return joined


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), tampered: dict[str, Column] | None = None) -> tuple[list[DataFrame], list[DataFrame]]:
    """Tiers of the sources' trees and of the tree over them. ``tampered`` replaces columns by expressions for
    the second hash of a row (``other``), which is null where it would be the same."""
    made = leaf([F.col(c) for c in columns])
    other = leaf([(tampered or {}).get(c, F.col(c)) for c in columns]) if tampered else F.lit(None).cast("string")
    changed = F.lit(False)
    for c, value in (tampered or {}).items():
        changed = changed | ~value.eqNullSafe(F.col(c))
    leaves = docs.select(F.col(id_col).cast("long").alias("id"), F.col(group_col).cast("string").alias("grp"), made.alias("digest"), F.when(changed, other).alias("other"))
    leaves = materialize(leaves, "merkle-leaves")
    placed = with_ordinals(leaves, [F.col("id").asc_nulls_first(), F.col("digest").asc(), F.col("other").asc()], group="grp", size="n")
    sources = forest(placed, "merkle-source")
    tops_ = tops(sources).select(F.col("grp").alias("id_grp"), "digest")
    over = with_ordinals(tops_.select("id_grp", F.lit(None).cast("string").alias("grp"), "digest"), [F.col("id_grp").asc_nulls_first()], group="grp", size="n")
    over = materialize(over, "merkle-over")
    trees = forest(over.select("grp", "n", "ordinal", F.lit(None).cast("long").alias("id"), "digest", F.lit(None).cast("string").alias("other")), "merkle-over")
    return sources, [over, *trees]


def verify(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), tampered: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, position of every row: its proof,
    and where the tampered row (the row itself, where ``tampered`` changes nothing) leads with it."""
    sources, (over, *trees) = manifest(docs, id_col, group_col, columns, tampered)
    root = tops(trees).select("digest").first()
    root = root[0] if root else ""
    top = F.lit(None).cast(STEP)
    of_root = tops(trees).select("grp", "tier", F.coalesce(top, F.array().cast(STEP)).alias("steps"), F.col("digest").alias("subroot"))
    # one row per source: the steps from its subroot to the root
    up = paths(trees, of_root).drop("ids", "others").mapInArrow(_paths, f"grp string, block long, steps {STEP}, subroot string")
    named = over.select(F.col("ordinal"), F.col("id_grp"), "digest").join(up.select("block", "steps"), F.col("ordinal") == F.col("block"))
    level = tops(sources).select(F.col("grp").alias("_g"), "tier")
    above = named.join(level, F.col("id_grp").eqNullSafe(F.col("_g"))).select(F.col("id_grp").alias("grp"), "tier", "steps", F.col("digest").alias("subroot"))
    above = materialize(above, "merkle-above")

    def prove(batch_iter):
        names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "position"]
        kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_(), pa.int64()]
        for b in batch_iter:
            for row in b.to_pylist():
                begin = row["block"] * BLOCK
                m, levels = min(BLOCK, row["n"] - begin), levels_of(row["n"])
                rest = [(s["place"], s["run"]) for s in row["steps"]]
                out = []
                for i, (doc_id, other) in enumerate(zip(row["ids"], row["others"])):
                    own = row["digests"][position(0, i, m)]
                    steps = path(row["digests"], m, levels, i) + rest
                    proof = digest("".join("".join(run) for _, run in steps))
                    folded = fold(other or own, steps)
                    out.append((doc_id, own, row["subroot"], root, proof, folded, folded == root, complete(begin + i)))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, position long"
    return paths(sources, above).mapInArrow(prove, schema)


def without_line_feeds(id_col: str = "doc_id", text_col: str = "text") -> dict[str, Column]:
    """The tampering of the query: line feeds go from every second document, by the CRC-32 of its id."""
    even = F.coalesce(F.crc32(F.col(id_col).cast("long").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    return {text_col: F.when(even, F.replace(F.col(text_col), F.lit("\n"), F.lit(""))).otherwise(F.col(text_col))}
