"""Gradient-boosted regression trees on histograms, a job a level of a tree.

The rules are those of Spark ML's boosted trees: features are cut into 32 bins at most, the first tree fits the target
(classes as -1 and 1), each further one the loss's residuals with the step size as its weight; a node takes the split
with the greatest variance gain, of a drawn subset of the features, and a leaf predicts its mean residual.

Rows lie in blocks of a byte a feature, kept by the executors in turn with each row's sum of trees. A tree begins with
the rows it draws and their residuals, kept until it is done: a byte a feature, a number and a weight. A level is a scan
of these: a task adds up its blocks' (node, feature, bin) sums and hands over one array, of a size that rows don't change.
Of two children only the lighter one is added up, the other is what it leaves of the parent; features of few bins are
added up together, in cells of all their bins. Sums are whole units and a row's draws come from its key's hash, so neither
order nor partitions change a tree. All trees so far are applied to the blocks anew every ``SNAPSHOT`` trees, which keeps
the lineage short.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 32
BLOCK = 1 << 15
#: Cells of features that are added up together.
CELLS = 1 << 10
#: Down to this level rows are routed by comparing all of a block's rows with each node's split.
_WIDE = 6
SNAPSHOT = 50
#: As the bytes that workers read: the default would compress and copy them again for each level.
_KEPT = StorageLevel.MEMORY_AND_DISK_DESER
#: Rows that are worth a task of their own, and the most that a task gets once all cores have one: a task's start takes as
#: long as some hundred thousand rows.
TASK_ROWS = 50_000
MOST_ROWS = 2_000_000
#: Values are whole multiples of 2**-24 of the greatest target, weights of 2**-20, so that their sums are exact.
_VALUE_BITS, _WEIGHT_UNIT = 24, 2.0 ** -20


@dataclass
class Tree:
    """Nodes in heap order from 1. A leaf above the lowest level hands its rows down on the left, with its value."""
    feature: np.ndarray
    split: np.ndarray
    value: np.ndarray
    weight: float


@dataclass
class BoostedTrees:
    thresholds: list[np.ndarray]
    trees: list[Tree]
    depth: int
    importances: np.ndarray

    def margin(self, features: Column) -> Column:
        """The weighted sum of the trees for an array of features."""
        thresholds, trees, depth = self.thresholds, self.trees, self.depth

        @F.pandas_udf("double")
        def summed(rows: pd.Series) -> pd.Series:
            out = np.zeros(len(rows))
            for lo in range(0, len(rows), BLOCK):
                bins = binned(np.stack(rows.iloc[lo:lo + BLOCK].to_numpy()), thresholds)
                for t in trees:
                    out[lo:lo + BLOCK] += t.weight * t.value[routed(t, bins, depth)]
            return pd.Series(out)

        return summed(features)

    def probability(self, features: Column) -> Column:
        """Of class 1."""
        return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * self.margin(features)))


def binned(x: np.ndarray, thresholds: list[np.ndarray]) -> np.ndarray:
    """A row a feature: the number of its thresholds that lie under the value."""
    return np.stack([np.searchsorted(t, x[:, f], side="left").astype(np.uint8) for f, t in enumerate(thresholds)])


def _places(tree: Tree, bins: np.ndarray, levels: int) -> np.ndarray:
    """Each row's place among the nodes of a level up to ``_WIDE``."""
    place = np.zeros(bins.shape[1], dtype=np.uint8)
    for level in range(levels):
        right = np.zeros(len(place), dtype=bool)
        for i in range(1 << level):
            node = (1 << level) + i
            if tree.split[node] < BINS:
                far = bins[tree.feature[node]] > int(tree.split[node])
                if level:
                    far &= place == i
                right |= far
        place += place
        place += right
    return place


def routed(tree: Tree, bins: np.ndarray, levels: int) -> np.ndarray:
    """The node of each row after ``levels`` levels."""
    wide = min(levels, _WIDE)
    node = _places(tree, bins, wide).astype(np.int64) + (1 << wide)
    if levels > wide:
        n = bins.shape[1]
        flat, rows = bins.reshape(-1), np.arange(n)
        starts = tree.feature * n
        for _ in range(wide, levels):
            right = flat.take(starts.take(node) + rows) > tree.split.take(node)
            node = 2 * node + right
    return node


def thresholds_of(df: DataFrame, features: str, n: int, bins: int = BINS) -> list[np.ndarray]:
    """Between all values of a feature of up to ``bins`` values, else at its approximate quantiles."""
    x = df.select(*[F.col(features)[i].alias(f"x{i}") for i in range(n)])
    probs = [i / bins for i in range(1, bins)]
    told = x.agg(*[F.percentile_approx(f"x{i}", probs, 10_000).alias(f"q{i}") for i in range(n)],
                 *[F.approx_count_distinct(f"x{i}").alias(f"n{i}") for i in range(n)]).first()
    few = [i for i in range(n) if told[f"n{i}"] <= 2 * bins]
    held = x.agg(*[F.collect_set(f"x{i}").alias(f"x{i}") for i in few]).first() if few else {}
    out = []
    for i in range(n):
        values = sorted(held[f"x{i}"]) if i in few else []
        if i in few and len(values) <= bins:
            out.append(np.array([(a + b) / 2.0 for a, b in zip(values, values[1:])]))
        else:
            out.append(np.unique(np.array(told[f"q{i}"], dtype=np.float64)))
    return out


# ---------------------------------------------------------------------------------------------
# What tasks do with their blocks: (bins, target, weight, hash[, sum of trees])
# ---------------------------------------------------------------------------------------------
def _blocks(thresholds: list[np.ndarray], batches):
    import pyarrow as pa

    n = len(thresholds)
    for batch in batches:
        for lo in range(0, len(batch), BLOCK):
            b = batch.slice(lo, BLOCK)
            if any(b.column(c).null_count for c in ("features", "target", "weight")) or b.column("features").flatten().null_count:
                raise ValueError("features, labels and weights must not be null")
            x = b.column("features").flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
            columns = [binned(x, thresholds).tobytes(), *[b.column(c).to_numpy(zero_copy_only=False).tobytes() for c in ("target", "weight", "h")]]
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in columns], names=["bins", "target", "weight", "h"])


def _merged(n: int, rows):
    """A task's rows in blocks of ``BLOCK`` rows at least, but for the last."""
    held, count = [], 0

    def block():
        bins = np.concatenate([np.frombuffer(r.bins, dtype=np.uint8).reshape(n, -1) for r in held], axis=1)
        target, weight = (_coded(np.concatenate([np.frombuffer(r[c]) for r in held])) for c in ("target", "weight"))
        return bins, target, weight, np.concatenate([np.frombuffer(r.h, dtype=np.uint64) for r in held])

    for r in rows:
        held.append(r)
        count += len(r.h) // 8
        if count >= BLOCK:
            yield block()
            held, count = [], 0
    if held:
        yield block()


def _coded(x: np.ndarray):
    """(values, a byte a row) of up to 256 values, else (x, None)."""
    values, codes = np.unique(x, return_inverse=True)
    return (values, codes.astype(np.uint8)) if len(values) <= 256 else (x, None)


def _decoded(x) -> np.ndarray:
    return x[0] if x[1] is None else x[0].take(x[1])


def _started(trees: list[Tree], depth: int, block):
    """The block with the sum of ``trees`` for each row."""
    total = np.zeros(len(block[3]))
    for t in trees:
        total += t.weight * t.value[routed(t, block[0], depth)]
    return *block, total


def _advanced(tree: Tree, depth: int, block):
    return *block[:4], block[4] + tree.weight * tree.value[routed(tree, block[0], depth)]


def _residual(classify: bool, first: bool, target, total):
    if first:
        return target
    return 4.0 * target / (1.0 + np.exp(2.0 * target * total)) if classify else 2.0 * (target - total)


def _drawn(classify: bool, first: bool, unit: float, draw: tuple[int, int, int] | None, block):
    """(bins, weighted residual in units, weight in units) of the rows that the tree draws."""
    bins, target, weight, h, total = block
    target, values = _decoded(target), _decoded(weight)
    at = slice(None)
    if draw is not None:
        a, shift, below = (np.uint64(v) for v in draw)
        at = np.flatnonzero((h * a + shift) >> np.uint64(40) < below)
        bins, target, values, total = bins.take(at, axis=1), target[at], values[at], total[at]
    value = np.rint(_residual(classify, first, target, total) * values / unit)
    if np.abs(value).max(initial=0.0) < 2.0**31:  # not where one is no number
        value = value.astype(np.int32)
    return bins, value, (np.rint(weight[0] / _WEIGHT_UNIT), weight[1][at]) if weight[1] is not None else (np.rint(values / _WEIGHT_UNIT), None)


def _together(sizes: list[int]) -> list[list[int]]:
    """Features in groups of up to ``CELLS`` cells, those of the most bins first."""
    groups: list[tuple[int, list[int]]] = []
    for f in sorted(range(len(sizes)), key=lambda f: (-sizes[f], f)):
        for i, (cells, own) in enumerate(groups):
            if cells * sizes[f] <= CELLS:
                groups[i] = cells * sizes[f], [*own, f]
                break
        else:
            groups.append((sizes[f], [f]))
    return [own for _, own in groups]


def _lighter(tree: Tree, bins: np.ndarray, level: int, side: list[int]):
    """The rows of each parent's child on its ``side`` (0 left, 1 right, 2 neither), and their parents' places."""
    if level - 1 > _WIDE:
        node = routed(tree, bins, level) - (1 << level)
        at = np.flatnonzero(np.array(side, dtype=np.int64).take(node >> 1) == (node & 1))
        return at, node[at] >> 1
    place = _places(tree, bins, level - 1)
    chosen = np.zeros(len(place), dtype=bool)
    for i, want in enumerate(side):
        if want < 2:
            node = (1 << level - 1) + i
            split = int(tree.split[node])
            own = bins[tree.feature[node]] > split if want else bins[tree.feature[node]] <= split
            own &= place == i
            chosen |= own
    at = np.flatnonzero(chosen)
    return at, place[at].astype(np.int64)


def _sums(tree: Tree, level: int, side: list[int], sizes: list[int], rows):
    """The task's sums of residuals and weights by (node, bins of all features): of the root, or for each node of the
    level above of its child on the ``side``."""
    nodes = max(1, len(side))
    groups = _together(sizes)
    cells = [math.prod(sizes[f] for f in own) for own in groups]
    added = [np.zeros((2, nodes * c)) for c in cells]
    for bins, value, (weights, codes) in rows:
        if level:
            at, base = _lighter(tree, bins, level, side)
            value = value[at]
            weight = weights[at] if codes is None else weights.take(codes[at])
        else:
            at = base = None
            weight = weights if codes is None else weights.take(codes)
        value = value.astype(np.float64)
        for own, c, out in zip(groups, cells, added):
            code = bins[own[0]].astype(np.uint16)
            for f in own[1:]:
                code *= np.uint16(sizes[f])
                code += bins[f]
            place = code.astype(np.int64) if at is None else base * c + code[at]
            out[0] += np.bincount(place, value, len(out[0]))
            out[1] += np.bincount(place, weight, len(out[1]))
    starts = np.cumsum([0, *sizes])
    told = np.zeros((2, nodes, starts[-1]))  # no bins that a feature doesn't have: small results travel faster
    for own, out in zip(groups, added):
        by = out.reshape(2, nodes, *[sizes[f] for f in own])
        for i, f in enumerate(own):
            told[:, :, starts[f] : starts[f + 1]] = by.sum(axis=tuple(2 + j for j in range(len(own)) if j != i))
    yield told


def _by_feature(told: np.ndarray, sizes: list[int]) -> np.ndarray:
    """Sums by (feature, node, bin) of those by (node, bins of all features)."""
    out = np.zeros((2, len(sizes), told.shape[1], BINS))
    for f, (a, z) in enumerate(zip(np.cumsum([0, *sizes]), np.cumsum(sizes))):
        out[:, f, :, : z - a] = told[:, :, a:z]
    return out


def _best(sums: np.ndarray, weights: np.ndarray, features: np.ndarray):
    """(gain, feature, bin) of the node's best split of sums by (feature, bin), None without gain."""
    s, w = sums.cumsum(axis=1)[:, :-1], weights.cumsum(axis=1)[:, :-1]
    all_s, all_w = sums[0].sum(), weights[0].sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = s * s / w + (all_s - s) ** 2 / (all_w - w) - all_s * all_s / all_w
    gain = np.where((w > 0) & (all_w - w > 0), gain, -np.inf)[features]
    at = int(gain.argmax())
    f, b = divmod(at, gain.shape[1])
    return (float(gain[f, b]), int(features[f]), b) if gain[f, b] > 0 else None


def boosted_trees(df: DataFrame, features: str, label: str, key: list[str], classify: bool, weight: str | None = None, *,
                  maxIter: int, maxDepth: int, stepSize: float, seed: int, subsamplingRate: float = 1.0,
                  featureSubsetStrategy: str = "1.0") -> BoostedTrees:
    """Trees of the rows of ``df``; ``features`` is an array of doubles, ``label`` 0 or 1 where ``classify``, and
    ``key`` names a row for its draws."""
    sc = df.sparkSession.sparkContext
    y = F.col(label).cast("double")
    df = df.select(F.col(features).alias("features"), (y * 2.0 - 1.0 if classify else y).alias("target"),
                   (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("weight"), F.xxhash64(*key).alias("h"))
    told = df.agg(F.count(F.lit(1)).alias("rows"), F.max(F.size("features")).alias("n"), F.max(F.abs("target")).alias("top")).first()
    if not told.rows:
        raise ValueError("no rows to train on")
    n, top = told.n, told.top or 1.0
    unit = 2.0 ** (math.frexp(top)[1] - _VALUE_BITS)
    thresholds = thresholds_of(df, "features", n)
    tasks, cores = -(-told.rows // TASK_ROWS), sc.defaultParallelism
    if tasks > cores:
        tasks = cores * -(-told.rows // (MOST_ROWS * cores))
    packed = df.mapInArrow(partial(_blocks, thresholds), "bins binary, target binary, weight binary, h binary")
    blocks = packed.repartition(tasks).rdd.mapPartitions(partial(_merged, n)).persist(StorageLevel.DISK_ONLY)  # read every ``SNAPSHOT`` trees only
    sizes = [len(t) + 1 for t in thresholds]
    subset = math.ceil(float(featureSubsetStrategy) * n)
    trees: list[Tree] = []
    importances = np.zeros(n)
    state = blocks.map(partial(_started, [], maxDepth)).persist(_KEPT)
    before = None
    for m in range(maxIter):
        rng = np.random.default_rng([seed, m])
        draw = None
        if subsamplingRate < 1.0:
            draw = (int(rng.integers(1 << 62)) * 2 + 1, int(rng.integers(1 << 62)), round(subsamplingRate * (1 << 24)))
        width = 2 << maxDepth
        tree = Tree(np.zeros(width, dtype=np.int64), np.full(width, 255, dtype=np.int64), np.zeros(width), stepSize if m else 1.0)
        ended = np.zeros(width, dtype=bool)
        drawn = state.map(partial(_drawn, classify, not m, unit, draw)).persist(_KEPT)
        side: list[int] = []
        for level in range(maxDepth):
            told = _by_feature(sum(drawn.mapPartitions(partial(_sums, tree, level, side, sizes)).collect()), sizes)
            if level:  # the heavier child is what the lighter one leaves of its parent
                own, told = told, np.zeros((2, n, 1 << level, BINS))
                for i, light in enumerate(side):
                    if light < 2:
                        told[:, :, 2 * i + light] = own[:, :, i]
                        told[:, :, 2 * i + 1 - light] = parents[:, :, i] - own[:, :, i]
            parents, side = told, []
            sums, weights = told
            if before is not None:
                before.unpersist()
                before = None
            for i in range(1 << level):
                node = (1 << level) + i
                s, w = sums[:, i] * unit, weights[:, i] * _WEIGHT_UNIT
                if level == 0:
                    tree.value[1] = s[0].sum() / w[0].sum() if w[0].sum() > 0 else 0.0
                chosen = np.sort(rng.permutation(n)[:subset])
                found = None if ended[node] else _best(s, w, chosen)
                if found is None:
                    side.append(2)
                    ended[2 * node] = ended[2 * node + 1] = True
                    tree.value[2 * node] = tree.value[node]
                    continue
                gain, f, b = found
                tree.feature[node], tree.split[node] = f, b
                importances[f] += gain
                left_s, left_w = s[f, :b + 1].sum(), w[f, :b + 1].sum()
                side.append(int(left_w > w[f].sum() - left_w))
                tree.value[2 * node] = left_s / left_w
                tree.value[2 * node + 1] = (s[f].sum() - left_s) / (w[f].sum() - left_w)
            if ended[2 << level:4 << level].all():
                break
        drawn.unpersist()
        _hand_down(tree, level + 1, maxDepth)
        trees.append(tree)
        if m + 1 < maxIter:
            before = state
            step = blocks.map(partial(_started, list(trees), maxDepth)) if (m + 1) % SNAPSHOT == 0 else state.map(partial(_advanced, tree, maxDepth))
            state = step.persist(_KEPT)
    for kept in (before, state, blocks):
        if kept is not None:
            kept.unpersist()
    return BoostedTrees(thresholds, trees, maxDepth, importances / importances.sum() if importances.sum() > 0 else importances)


def _hand_down(tree: Tree, level: int, depth: int) -> None:
    """Leaves' values to the lowest level, where rows of a tree that ended early arrive."""
    for node in range(1 << level, 1 << depth):
        tree.value[2 * node] = tree.value[node]
